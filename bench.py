"""Times the headline queries: one JSON line.  BENCH_SF_DIR names the tables, BENCH_CPUS the local cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "pricing_summary inner_3way using_join having count_distinct rollup cube stats percentile row_number_top_n running_sum_rows moving_avg_range_interval asof_events interval_events "
    "range_price session_windows sliding_windows top_k except_distinct exact_dup_docs label_join merge_upsert string_fns date_trunc_diff"
).split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from brindle.plans import catalogue
    from brindle.session import session

    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalogue()
    run = lambda q: q(spark, folder).write.format("noop").mode("overwrite").save()
    run(queries["pricing_summary"])  # starts the JVM's workers and reads footers
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            run(queries[name])
            times.append(time.perf_counter() - began)
        seconds[name] = round(sorted(times)[1], 4)
    print(json.dumps({"metric": "headline queries, sum of medians of 3", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
