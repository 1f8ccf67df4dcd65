"""All queries of the library outside its text-corpus subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lawloom.plans import core, known, lawside, shapes, tables


def queries() -> dict[str, core.Query]:
    return {**core.QUERIES, **known.queries(), **shapes.queries(), **tables.QUERIES, **lawside.QUERIES}


def oracles() -> dict[str, str]:
    return {**core.ORACLES, **known.oracles(), **shapes.oracles(), **tables.ORACLES, **lawside.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.p1_report(spark, sf_dir)
