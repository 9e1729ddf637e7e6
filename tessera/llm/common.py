"""What the operators share: intermediate tables, bounded slices of Arrow batches, row keys."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import tables
from tessera.plans.tables import shared_dir as shared_dir

#: What stands for a doc_id that is null where numbers are needed.
LAST = 2**63 - 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII white space, which ends a word; everything else is part of one.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_OPEN, _LOCK = [], threading.Lock()  # what the setting was before the first of the writes that run now


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: lineage ends here, lost executors cost nothing. Its shuffle
    files go as soon as the table is there; writes may run at the same time."""
    conf = df.sparkSession.conf
    with _LOCK:
        _OPEN.append(_OPEN[0] if _OPEN else conf.get(CLEANUP, None))
        conf.set(CLEANUP, "true")
    try:
        return tables.materialize(df, name)
    finally:
        with _LOCK:
            before = _OPEN.pop()
            if not _OPEN:
                conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for f in df.inputFiles()[:1]:
            at = jvm.org.apache.hadoop.fs.Path(f).getParent()
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that have been written out."""
    spark.sparkContext._jvm.System.gc()


def row_key(df: DataFrame) -> DataFrame:
    """_key: doc_id; for null ids a number from 2**62 on that comes of the text, so that they follow all other documents
    and don't meet in one task. _tag tells apart rows of one doc_id with different texts."""
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    return df.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + tag.bitwiseAND(F.lit(2**62 - 1))), "_tag": tag})


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, _key, _tag and nothing else, whatever other columns docs has."""
    return row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text, so that what Python makes of one stays small."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64) + 64
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; nothing for null."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 of uint64 values."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


class Memo(dict):
    """Remembers what make() gave for the first so many keys, among which are the frequent ones."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        out = self.make(key)
        if len(self) < self.most:
            self[key] = out
        return out


def windows(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of each run of `size` values, modulo 2**64; len(h) - size + 1 of them."""
    b = np.uint64(base | 1)
    with np.errstate(over="ignore"):
        power = lambda n: np.uint64(pow(int(b), n, 2**64))
        out, have, block, width = None, 0, h, 1
        rest = size
        while rest:
            if rest & 1:
                if out is None:
                    out, have = block, width
                else:
                    n = len(h) - (have + width) + 1
                    out, have = out[:n] + power(have) * block[have : have + n], have + width
            rest >>= 1
            if rest:
                n = max(0, len(block) - width)
                block, width = block[:n] + power(width) * block[width : width + n], width * 2
    return out[: max(0, len(h) - size + 1)]
