"""Headline queries on $BENCH_SF_DIR, local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from crawlframe.queries import QUERIES
from crawlframe.session import session

HEADLINE = ["links_per_host", "enqueue_skip_reasons", "request_identity", "html_records", "host_round_robin", "stats_summary", "stats_rate_window", "aimd_fold", "antibot_detect", "bfs_depth_limit"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", int(os.environ.get("BENCH_CPUS", "8")), spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total of headline queries, second run each", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
