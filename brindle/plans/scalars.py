"""Scalar functions by family."""

from pyspark.sql import functions as F

from .. import functions as G
from . import query


@query("""SELECT p_partkey, upper(p_brand) AS up, substr(p_name, 2, 3) AS mid, lpad(p_partkey::VARCHAR, 8, '0') AS padded, replace(p_type, ' ', '_') AS under,
    length(p_name) AS len, reverse(p_brand) AS rev, instr(p_name, 'a')::BIGINT AS at, string_split(p_name, ' ')[1] AS first, starts_with(p_name, 'b') AS b FROM part""")
def string_fns(t, spark):
    n = F.col("p_name")
    return t("part").select(
        "p_partkey", F.upper("p_brand").alias("up"), G.substr(n, 2, 3).alias("mid"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"),
        F.replace(F.col("p_type"), F.lit(" "), F.lit("_")).alias("under"), F.length(n).cast("bigint").alias("len"), F.reverse("p_brand").alias("rev"),
        F.instr(n, "a").cast("bigint").alias("at"), F.get(G.split(n, " "), F.lit(0)).alias("first"), F.startswith(n, F.lit("b")).alias("b"),
    )


@query("""SELECT c_custkey, CASE WHEN regexp_matches(c_name, '[0-9]+') THEN regexp_extract(c_name, '0*([0-9]+)$', 1) END AS num, regexp_replace(c_name, '([A-Za-z]+)#?', '<\\1>') AS tagged,
    regexp_matches(c_mktsegment, '^[A-F]') AS early, len(regexp_extract_all(c_name, '[0-9]'))::BIGINT AS digits FROM customer""")
def regex_fns(t, spark):
    n = F.col("c_name")
    return t("customer").select(
        "c_custkey", G.regexp_extract(n, "0*([0-9]+)$", 1).alias("num"), F.regexp_replace(n, "^([A-Za-z]+)#?", "<$1>").alias("tagged"),
        F.col("c_mktsegment").rlike("^[A-F]").alias("early"), F.regexp_count(n, F.lit("[0-9]")).cast("bigint").alias("digits"),
    )


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m, date_diff('month', o_orderdate::DATE, DATE '2000-01-01') AS months,
    date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS days, year(o_orderdate)::BIGINT AS y, quarter(o_orderdate)::BIGINT AS q,
    (o_orderdate::DATE - dayofweek(o_orderdate)::INT)::DATE AS sunday, strftime(o_orderdate, '%Y-%m') AS ym, last_day(o_orderdate::DATE) AS last,
    (dayofyear(o_orderdate) + 6 - dayofweek(o_orderdate)) // 7 AS week FROM orders""")
def date_trunc_diff(t, spark):
    d, end = F.to_date("o_orderdate"), F.lit("2000-01-01").cast("date")
    return t("orders").select(
        "o_orderkey", G.date_trunc(d, "month").alias("m"), G.date_diff(end, d, "MONTH").alias("months"), G.date_diff(end, d, "DAY").alias("days"),
        F.year(d).cast("bigint").alias("y"), F.quarter(d).cast("bigint").alias("q"), G.date_trunc(d, "WEEK").alias("sunday"), G.format_date("%Y-%m", d).alias("ym"),
        F.last_day(d).alias("last"), G.extract_week(d).alias("week"),
    )


@query("""SELECT event_id, date_diff('hour', TIMESTAMP '2024-01-01 00:59:00', ts) AS hours, date_sub('hour', TIMESTAMP '2024-01-01 00:59:00', ts) AS whole,
    date_trunc('hour', ts) AS h, epoch_us(ts) AS us, ts + INTERVAL 90 MINUTE AS later FROM events""")
def time_fns(t, spark):
    ts, base = F.col("ts"), F.lit("2024-01-01 00:59:00").cast("timestamp_ntz")
    return t("events").select(
        "event_id", G.datetime_diff(ts, base, "HOUR").alias("hours"), G.timestamp_diff(ts, base, "HOUR").alias("whole"),
        F.date_trunc("hour", ts).cast("timestamp_ntz").alias("h"), F.unix_micros(ts.cast("timestamp")).alias("us"), (ts + F.expr("INTERVAL 90 MINUTES")).alias("later"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, round(ln(l_extendedprice), 6) AS l, round(ln(l_quantity) / ln(2), 6) AS l2, floor(l_tax * 100)::BIGINT AS f,
    (l_orderkey % 7)::BIGINT AS m, l_orderkey // 7 AS d, round(sqrt(l_quantity) + power(l_discount, 2), 6) AS s, greatest(l_discount, l_tax) AS g, sign(l_discount - l_tax)::DOUBLE AS sg FROM lineitem""")
def math_fns(t, spark):
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.round(F.ln(x), 6).alias("l"), F.round(G.log(q, F.lit(2)), 6).alias("l2"), F.floor(F.col("l_tax") * 100).alias("f"),
        (F.col("l_orderkey") % 7).alias("m"), F.expr("l_orderkey div 7").alias("d"), F.round(F.sqrt(q) + F.pow("l_discount", F.lit(2)), 6).alias("s"),
        G.greatest(F.col("l_discount"), F.col("l_tax")).alias("g"), F.sign(F.col("l_discount") - F.col("l_tax")).alias("sg"),
    )


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events""")
def json_fns(t, spark):
    return t("events").select("event_id", G.json_value(F.col("props"), "$.k").alias("k"), G.json_value(F.col("props"), "$.none").alias("none"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey <> 0 THEN s_acctbal / s_nationkey END AS r, TRY_CAST(CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '12' END AS BIGINT) AS c,
    TRY_CAST('2024-02-30' AS DATE) AS d FROM supplier""")
def safe_fns(t, spark):
    text = F.when(F.col("s_suppkey") % 2 == 0, "x").otherwise("12")
    return t("supplier").select(
        "s_suppkey", G.safe_divide(F.col("s_acctbal"), F.col("s_nationkey")).alias("r"), text.try_cast("bigint").alias("c"), F.lit("2024-02-30").try_cast("date").alias("d")
    )


@query("SELECT n_name, md5(n_name) AS m, sha256(n_name) AS s, lower(hex(n_name)) AS h, to_base64(n_name::BLOB) AS b FROM nation")
def hash_fns(t, spark):
    n = F.col("n_name")
    return t("nation").select(n, G.to_hex(G.md5_bytes(n)).alias("m"), F.sha2(n, 256).alias("s"), G.to_hex(n).alias("h"), F.base64(n.cast("binary")).alias("b"))


@query("""SELECT c_custkey, (c_nationkey & 6)::BIGINT AS a, (c_nationkey | 1)::BIGINT AS o, xor(c_nationkey, 5)::BIGINT AS x, (c_nationkey::BIGINT << 2) AS l, bit_count(c_nationkey)::BIGINT AS n FROM customer""")
def bit_fns(t, spark):
    n = F.col("c_nationkey").cast("bigint")
    return t("customer").select(
        "c_custkey", n.bitwiseAND(6).alias("a"), n.bitwiseOR(1).alias("o"), n.bitwiseXOR(5).alias("x"), F.shiftleft(n, 2).alias("l"), F.bit_count(n).cast("bigint").alias("n")
    )


@query("""SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(38, 9)) AS n, round(o_totalprice)::BIGINT AS i, (o_orderkey > 10)::VARCHAR AS b, o_orderkey::VARCHAR AS s FROM orders""")
def cast_fns(t, spark):
    p = F.col("o_totalprice")
    return t("orders").select("o_orderkey", G.numeric(p).alias("n"), G.cast_float_to_int(p).alias("i"), (F.col("o_orderkey") > 10).cast("string").alias("b"), F.col("o_orderkey").cast("string").alias("s"))


@query("SELECT p_partkey, (list_sum(list_transform([0, 10, 20, 30, 40], lambda b: (b <= p_size)::INT)))::BIGINT AS bucket FROM part")
def range_bucket(t, spark):
    return t("part").select("p_partkey", G.range_bucket(F.col("p_size"), F.array(*[F.lit(x) for x in (0, 10, 20, 30, 40)])).alias("bucket"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'number' WHEN 4 THEN 'boolean' ELSE 'null' END AS kind,
    CASE json_type(props -> 'k') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' END AS of_k FROM events""")
def json_types(t, spark):
    pick = F.element_at(F.array(*[F.lit(x) for x in ('{"a": 1}', "[1]", '"x"', "2.5", "true", "null")]), (F.col("event_id") % 6 + 1).cast("int"))
    return t("events").select("event_id", G.json_type(pick).alias("kind"), G.json_type(F.col("props"), "$.k").alias("of_k"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_id END AS i, CASE event_id % 4 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN event_id::DOUBLE END AS d,
    CASE event_id % 4 WHEN 0 THEN event_id <> 0 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END AS b,
    CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN 'word' END AS s FROM events""")
def lax_fns(t, spark):
    n = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 4 == 0, n).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"'), n, F.lit('"'))).when(F.col("event_id") % 4 == 2, F.lit('"word"')).otherwise(F.lit("[1]"))
    return t("events").select("event_id", G.lax_int64(text).alias("i"), G.lax_float64(text).alias("d"), G.lax_bool(text).alias("b"), G.lax_string(text).alias("s"))


@query("""SELECT s_suppkey, (-round(abs(s_acctbal), 2))::DECIMAL(38, 9) AS n, 'host' || s_suppkey || '.example.org' AS host, (s_suppkey % 256)::BIGINT AS last, NULL::VARCHAR AS bad FROM supplier""")
def net_and_numeric_fns(t, spark):
    k = F.col("s_suppkey").cast("string")
    number = F.concat(F.lit(" "), F.format_number(F.abs("s_acctbal"), 2), F.lit(" - "))
    ip = G.net_ip_from_string(F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 256).cast("string")))
    url = F.concat(F.lit("https://me@host"), k, F.lit(".example.org:80/a?b#c"))
    return t("supplier").select(
        "s_suppkey", G.parse_numeric(number).alias("n"), G.net_host(url).alias("host"), F.conv(F.right(F.hex(ip), F.lit(2)), 16, 10).cast("bigint").alias("last"),
        F.hex(G.net_ip_from_string(F.concat(F.lit("300.1.1."), k))).alias("bad"),
    )


@query("SELECT p_partkey, printf('%.2f', p_retailprice) AS price FROM part")
def cast_format_fns(t, spark):
    price = F.col("p_retailprice").cast("decimal(12,2)")
    return t("part").select("p_partkey", F.trim(G.cast_format(price, "9999990.99")).alias("price"))
