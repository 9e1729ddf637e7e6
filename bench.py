"""Times the headline queries over the code graph at $BENCH_SF_DIR and prints one JSON line.

`load` writes the relations once; every query then starts without anything that an earlier one has derived."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.driver_queries import CODE_QUERIES, queries
from tessera.sources.views import code

#: The nine published query shapes, in their order.
HEADLINE = ("b1_functions", "d09_ambiguous", "d17_impact_of_const", "d18_reach_of", "b5_innermost_about", "b6_imports", "b7_dead_in_core", "b8_fan_in", "d30_depends")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run, took = queries(), {}
    start = time.time()
    code(spark, sf).fill()
    took["load"] = round(time.time() - start, 3)
    for name in HEADLINE:
        assert name in CODE_QUERIES
        code(spark, sf, warm=False)
        t = time.time()
        run[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "code_graph_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
