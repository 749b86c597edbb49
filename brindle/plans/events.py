"""Event time: windows, sessions, funnels, deduplication.  The streaming forms are in brindle.streaming."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming.windows import sessions, sliding, tumbling
from . import query


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(t, spark):
    return tumbling(t("events"), "ts", "1 day", ["event_type"]).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"
    )


@query("""SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * unnest([0, 1]) AS start FROM events) GROUP BY 1""")
def sliding_windows(t, spark):
    return sliding(t("events"), "ts", "1 hour", "30 minutes", []).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t, spark):
    return sessions(t("events"), "ts", "1 hour", ["user_id"]).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS v FROM events GROUP BY 1),
c AS (SELECT e.user_id, min(ts) AS c FROM events e JOIN f USING (user_id) WHERE event_type = 'click' AND ts >= v GROUP BY 1),
p AS (SELECT e.user_id, min(ts) AS p FROM events e JOIN c USING (user_id) WHERE event_type = 'purchase' AND ts >= c.c GROUP BY 1)
SELECT count(v) AS viewed, count(c) AS clicked, count(p) AS bought FROM f LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id)""")
def funnel(t, spark):
    """Three steps in order, in one pass over each user's events."""
    w = Window.partitionBy("user_id")
    first = lambda kind, after: F.min(F.when((F.col("event_type") == kind) & after, F.col("ts"))).over(w)
    rows = t("events").withColumn("v", first("view", F.lit(True)))
    rows = rows.withColumn("c", first("click", F.col("ts") >= F.col("v")))
    rows = rows.withColumn("p", first("purchase", F.col("ts") >= F.col("c")))
    users = rows.groupBy("user_id").agg(F.max("v").alias("v"), F.max("c").alias("c"), F.max("p").alias("p"))
    return users.agg(F.count("v").alias("viewed"), F.count("c").alias("clicked"), F.count("p").alias("bought"))


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def dedup_first(t, spark):
    return t("events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""SELECT user_id, round(avg(gap), 3) AS gap FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events) GROUP BY 1""")
def mean_gap(t, spark):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts"))) / 1e6
    return t("events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.round(F.avg("gap"), 3).alias("gap"))
