"""Wall time of the headline queries; prints one JSON line.

Every query starts from the given tables: shared stage tables are dropped before
each timing.  One untimed pass on the smallest tables warms up the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from checks import registry  # noqa: E402

HEADLINE = [
    "all_shifts",
    "target_minutes",
    "candidates_team_mode",
    "candidates_player_mode",
    "free_candidates",
    "score_roster",
    "roster_violations",
    "stats_person",
    "roster_layout",
    "ingest_games",
    "date_pack",
    "assigner_summary",
    "candidates_hot_org",
    "assigner_player_mode",
    "assigner_hot_org",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rotaloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="rotaloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = sys.argv[1:] or HEADLINE

    def run(name: str, folder: str) -> float:
        registry.forget()
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - began

    if os.path.isdir(warm_dir):
        for name in wanted:
            run(name, warm_dir)
    times = {name: round(run(name, sf_dir), 3) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
