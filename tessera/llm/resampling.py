"""Quality by importance resampling.

Two generative models over hashed words and word pairs: one of the target (documents labelled good), one
of all raw text. A document's weight is the ratio of its likelihoods under them; Gumbel noise added to
the log weights and the largest k kept is a sample without replacement in proportion to the weights.

Defined results: null and empty texts have log weight 0. The noise comes from the text and the id, so
equal rows get equal keys and runs agree; rows with the key of the k-th are all kept. Without labels the
target is the raw model and the sample is uniform. k is the share of good labels times the rows.
Texts of any length are read whole; columns but doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LAST, Memo, materialize, mix, slices, texts_of, windows

BUCKETS, MOST_TARGET = 10_000, 20_000


def _buckets(texts: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of each text, and which text each is of."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    h = np.fromiter((x for w in split for x in map(memo.__getitem__, w)), dtype=np.uint64, count=int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        pair = mix(windows(h, 2, 0x8CB92BA72F3D8DD7)) if len(h) > 1 else h[:0]
    inner = doc[: len(pair)] == doc[1:]
    return (np.concatenate([h, pair[inner]]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([doc, doc[: len(pair)][inner]])


def _memo() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w, seed=17), 500_000)


def models(docs: DataFrame, target: set[int]) -> np.ndarray:
    """Counts of each bucket in all documents and in the target ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = _memo(), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                bucket, doc = _buckets(texts_of(part), memo)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                good = np.array([d in target for d in part.column(0).to_pylist()], dtype=bool)
                total[1] += np.bincount(bucket[good[doc]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "raw", "target"])

    counts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "bucket long, raw long, target long")
    out = np.zeros((2, BUCKETS))
    for b, raw, good in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # BUCKETS rows
        out[:, b] = raw, good
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log of target over raw probability of each bucket, with one added to each count."""
    if not counts[1].sum():
        return np.zeros(counts.shape[1])
    p = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """doc_id, log_weight and key (with Gumbel noise) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                bucket, doc = _buckets(texts, memo)
                w = np.bincount(doc, weights=ratio[bucket], minlength=len(texts)).astype(np.float64)  # whole numbers if there is no word at all
                ids = np.array([LAST if d is None else d for d in part.column(0).to_pylist()], dtype=np.int64).view(np.uint64)
                own = np.array([xxhash.xxh64_intdigest(t, seed=seed) for t in texts], dtype=np.uint64)
                u = ((mix(own ^ mix(ids, seed)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w), pa.array(w - np.log(-np.log(u)))], names=["doc_id", "log_weight", "key"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, log_weight double, key double")


def kth_largest(df: DataFrame, column: str, k: int, most: int = 100_000) -> float | None:
    """The k-th largest value, by narrowing a range with quantile sketches until few rows are left in it."""
    low, high, above = float("-inf"), float("inf"), 0
    if k < 1:
        return None
    while True:
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high)).select(column)
        n = inside.count()
        if above + n < k:
            return None
        if n <= most:
            return sorted((r[0] for r in inside.collect()), reverse=True)[k - above - 1]
        cuts = sorted(set(inside.agg(F.percentile_approx(column, [i / 64 for i in range(1, 64)], 10_000)).first()[0]))
        counts = inside.agg(*(F.count_if(F.col(column) > c) for c in cuts)).first()
        over = [above + x for x in counts]
        lower = max((c for c, x in zip(cuts, over) if x >= k), default=None)  # the k-th is above it
        upper = min((c for c, x in zip(cuts, over) if x < k), default=None)  # and at most this
        new_low = low if lower is None else float(np.nextafter(lower, np.inf))
        new_high = high if upper is None else upper
        above = above if upper is None else over[cuts.index(upper)]
        if (new_low, new_high) == (low, high) or new_low == new_high:
            return new_high
        low, high = new_low, new_high


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1) -> DataFrame:
    """doc_id, log_weight, key and kept (among the k largest keys) of each row of docs."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null")
    n, good = known.agg(F.count("*"), F.sum("quality")).first()
    share = share if share is not None else (good or 0) / n if n else 1.0
    chosen = known.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(MOST_TARGET)
    target = {r[0] for r in chosen.collect()}
    rows = materialize(weigh(docs, log_ratio(models(docs, target)), seed), "weights")
    cut = kth_largest(rows, "key", round(share * rows.count()))
    return rows.withColumn("kept", F.lit(False) if cut is None else F.col("key") >= F.lit(cut))
