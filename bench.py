"""Times the headline statements: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the threads."""

from __future__ import annotations

import json
import os
import statistics
import time

from granary.operators.statements import STATEMENTS
from granary.session import session
from granary.sources.tables import open_table

RUNS = 3
HEADLINE = [name for name in STATEMENTS if name.startswith("q")]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session("granary-bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # tables are opened once, as the figures to compare with have them; each run parses, plans and executes
    tables = {name: open_table(spark, f"{sf_dir}/{name}.parquet") for name in {STATEMENTS[q].table for q in HEADLINE}}
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):  # the first compiles
            began = time.perf_counter()
            STATEMENTS[name].over(tables[STATEMENTS[name].table]).collect()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "sum of 43 headline statements, median of 3", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
