"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: median of three runs, each writing its rows away."""

import json
import os
import time
import warnings
from statistics import median

from pyspark.sql import SparkSession

from hornspark import catalogue

NAMES = "scan_all select_const prefix_arity project_distinct join2 join3 join5 join_multi_key self_join semi_join_shape union_rules edb_plus_idb tc_linear tc_nonlinear tc_cyclic tc_from_constant mutual_recursion tc_lines".split()


def main() -> None:
    warnings.simplefilter("ignore")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalogue.run_query(spark, sf_dir, "join2").count()
    for name in NAMES:
        runs = []
        for _ in range(3):
            began = time.time()
            catalogue.run_query(spark, sf_dir, name).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(median(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
