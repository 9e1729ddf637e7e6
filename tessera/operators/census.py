"""Counts of what is there, and symbols that collide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.engine import Engine


def census(e: Engine) -> DataFrame:
    """what, value, n: rows of each relation, definitions by kind, references by role, files by language, anchored definitions."""
    e.fill()
    line = lambda what, value: (F.lit(what).alias("what"), value.alias("value"), F.col("n"))
    parts = [df.agg(F.count("*").alias("n")).select(*line(name, F.lit(""))) for name, (df, _) in e.base.items()]
    for what, name, column in (("kind", "def", "c2"), ("role", "scip_ref", "c5"), ("language", "file", "c1")):
        parts.append(e.base[name][0].groupBy(column).agg(F.count("*").alias("n")).select(*line(what, F.col(column))))
    known = e.base["def"][0].select("c0").distinct().join(e.base["resolved"][0].select("c0").distinct(), "c0", "left_semi")
    parts.append(known.agg(F.count("*").alias("n")).select(*line("anchored", F.lit(""))))
    return reduce(DataFrame.unionByName, parts)


def collisions(places: DataFrame) -> DataFrame:
    """Symbols s that stand in several files f, with how many."""
    return places.groupBy("s").agg(F.count_distinct("f").alias("n")).where("n > 1")


def collisions_at(places: DataFrame) -> DataFrame:
    """Places f, line, col at which several symbols s stand, with how many."""
    return places.groupBy("f", "line", "col").agg(F.count_distinct("s").alias("n")).where("n > 1")
