
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    import bench
    from lawloom.plans import baseline, known, tables

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    plain = dict(baseline.BASELINES)
    try:
        from lawloom.llm import baseline as llm

        plain |= llm.BASELINES
    except ImportError:
        pass
    took: dict[str, float] = {}
    for name in bench.HEADLINE:
        if name in baseline.OVER_TEXTS:
            texts = _texts(name, d, known, tables)
            start = time.perf_counter()
            baseline.OVER_TEXTS[name](texts)
        elif name in plain:
            start = time.perf_counter()
            plain[name](d)
        else:
            continue
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "one_thread_python", "unit": "sec", "value": round(sum(took.values()), 3), "queries": took}))


def _texts(name: str, d: str, known, tables) -> list[str]:
    """The texts of a query, made by Spark outside the clock."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if name == "bill_sections":
        made = tables._many(spark, d)
    elif name == "usc_scan":
        made = tables._sql(spark, d, tables._SCANNED, "orders").withColumn("text", F.expr("concat('See ', t, ' U.S.C. ', s, p, ' and 9 USC § 12.')"))
    else:
        made = known.RECIPES[name].made(spark, d)
    return made.select("text").toPandas()["text"].tolist()


if __name__ == "__main__":
    main()
