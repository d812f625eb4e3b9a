"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds for each.

Every query is planned and run anew over resident tables: as a frame (``queries``), and as the whole ``Engine.query`` with its
caps, order of errors and sums in the order of rows (``by_query``; results over the cap of 100,000 rows are run uncapped).
``floor`` is the time of a Spark job that does nothing, of which each query has one or more.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from veltra import catalogue  # noqa: E402
from veltra.engine import RESULT_LIMIT  # noqa: E402
from veltra.errors import EngineError  # noqa: E402

HEADLINE = ["flagship", *(q for q in catalogue.QUERIES if q.startswith("bench_"))]


def median(run, rounds: int = 7, warm: int = 5) -> float:
    """Of ``rounds`` runs, after some that compile code."""
    took = []
    for _ in range(warm + rounds):
        begin = time.perf_counter()
        run()
        took.append(time.perf_counter() - begin)
    return round(statistics.median(took[warm:]), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "false")  # resident tables of known size: nothing to plan anew between stages
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = catalogue.engine(spark, sf_dir)
    for t in engine.catalog.tables.values():
        t.source.frame = t.source.frame.repartition(int(cpus)).persist()
        t.source.frame.count()
    seconds, whole = {}, {}
    for name in HEADLINE:
        sql = catalogue.dialect(catalogue.QUERIES[name])
        seconds[name] = median(lambda: engine.frame(sql).toArrow())  # noqa: B023
        engine.result_limit = RESULT_LIMIT
        try:
            engine.query(sql)
        except EngineError:  # more rows than the cap
            engine.result_limit = None
        whole[name] = median(lambda: engine.query(sql), 3, 2)  # noqa: B023
    floor = median(lambda: spark.range(1).toArrow())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "by_query": whole, "floor": floor, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
