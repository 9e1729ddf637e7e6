"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in local mode with none set."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        sc.setCheckpointDir(at)
    return at


#: Rows from which a written table counts as large.
LARGE = 250_000


def unsized(df: DataFrame) -> DataFrame:
    """df with a size that Spark doesn't know before it runs, and so takes for large: by that of its compressed files it
    would send tables to the driver and all executors that take many times as much there. AQE goes by what it measures."""
    spark = df.sparkSession
    none = spark._jsparkSession.createDataFrame(spark.sparkContext._jsc.emptyRDD(), df._jdf.schema())  # no partition, no task
    return df.unionByName(DataFrame(none, spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df from a written table: the lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/relations/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """materialize(), and the number of rows, which the write itself counts; unsized() if they are many."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    n = observed(seen)
    n = out.count() if n is None else n
    return unsized(out) if n > LARGE else out, n


def observed(seen: Observation) -> int | None:
    """The count of an observation once its action is over; None where the planner found nothing to run."""
    try:
        n = seen._jo.getOrEmpty().get("n")
        return n.get() if n.isDefined() else None
    except Py4JJavaError:  # no row at all came of it
        return None
