"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over words and pieces of words, trained in numpy from confirmed toxic documents and
from unlabelled text. The risk of the unlabelled ones is corrected by the class prior, and where the
corrected risk would turn negative the step goes up instead of down. No negative label is read: the
prior is estimated from scores of the two samples (see class_prior), between LEAST_PRIOR and MOST_PRIOR.

The samples are bounded: at most MOST_POSITIVE confirmed documents and MOST_UNLABELLED documents outside
the confirmed ones, those without any label first. Features are hashed and counted in the executors; the
driver gets the FEATURES chosen ones of each sampled document and no text. Of confirmed documents that are
copies of each other one trains, since else the words of any copied text would pass for toxic.

Defined results: null and empty texts get the score of a document without features; labels, language,
source and doc_id are never inputs of a score; documents held out and rows without doc_id are no part of
the training; of rows that share a doc_id the one with the smallest text trains. With no confirmed
document every score is 0; repeated rows get equal scores; columns of any name are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, discard, materialize, mix, slices

MOST_POSITIVE, MOST_UNLABELLED, FEATURES = 1500, 4500, 1024
LEAST_PRIOR, MOST_PRIOR = 0.005, 0.5
#: A feature is so many times as frequent in confirmed documents as in unlabelled ones.
LEAST_LIFT = 3.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def pieces(word: str) -> frozenset[int]:
    """Hashes of the features of a word: itself, its starts, and its runs of 5 characters with marked ends."""
    w = f"<{word.strip('.,;:!?()[]|')}>"
    return frozenset(xxhash.xxh64_intdigest(f) >> 1 for f in (w, *(w[: k + 1] for k in (3, 4, 5, 6) if k + 1 < len(w)), *(w[i : i + 5] for i in range(len(w) - 4))))


def features(text: str | None, memo: Memo) -> set[int]:
    return set().union(*map(memo.__getitem__, set((text or "").lower().split())))


def sketches(text: str | None) -> list[int]:
    """Two hashes of a text's five lowest words, each under another order: copies and near copies have one in common, most of them."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in set((text or "").lower().split())], dtype=np.uint64)
    return [xxhash.xxh64_intdigest(np.sort(mix(h, k))[:5].tobytes()) >> 1 for k in (1, 2)]


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of weights with the bias last: the risk of positives, the corrected risk of negatives, and their gradients (logistic loss)."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    of_p, of_u = prior * (sigmoid(zp) - 1) / len(zp), sigmoid(zu) / len(zu)
    off = -prior * sigmoid(zp) / len(zp)  # what positives among the unlabelled add
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    of_p, of_u, off = (x.astype(w.dtype) for x in (of_p, of_u, off))
    return float(positive), float(negative), np.append(of_p @ p, of_p.sum()), np.append(of_u @ u + off @ p, of_u.sum() + off.sum())


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, seed: int, steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Weights of a linear classifier, the bias last: Adam on the non-negative risk of a bootstrap sample."""
    rng = np.random.default_rng(seed)
    p, u = p[rng.integers(0, len(p), len(p))], u[rng.integers(0, len(u), len(u))]
    w = np.zeros(p.shape[1] + 1, dtype=np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, negative, gp, gn = risk(w, p, u, prior)
        g = (gp + gn if negative >= 0 else -gn).astype(np.float32)  # it would turn negative: up instead of down
        g[:-1] += np.float32(decay) * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def share_above(p: np.ndarray, u: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled scores: how many times rarer scores above a cut are there than among
    positives, at the cut where the upper bound of that ratio is least (best bin estimation)."""
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)) * above_u / above_p)
    best = np.argmin((above_u + slack) / above_p)
    return float(above_u[best] / above_p[best])


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in u: each half is scored by a classifier of the other halves."""
    if min(len(p), len(u)) < 4:
        return LEAST_PRIOR
    found = []
    for a, b in ((0, 1), (1, 0)):
        w = nnpu(p[a::2], u[a::2], 0.1, seed=11, steps=100)
        found.append(share_above(p[b::2] @ w[:-1], u[b::2] @ w[:-1]))
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, np.mean(found))))


def train(p: np.ndarray, u: np.ndarray, names: list[int], prior: float | None = None, members: int = 3) -> dict:
    """Mean weights of some classifiers, each from another seed. Rows of p and u are 0 or 1 for each of names."""
    prior = class_prior(p, u) if prior is None else prior
    w = np.mean([nnpu(p, u, prior, seed) for seed in range(members)], axis=0)
    return {"weights": {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, "bias": float(w[-1]), "prior": prior}


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """positive and ids (hashes of the features, distinct) of the documents that train; None without a confirmed one."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    rank = F.xxhash64(F.col("doc_id"), F.lit(7))
    first = lambda rows, most: [r[0] for r in rows.select("doc_id").distinct().orderBy(rank, "doc_id").limit(most).collect()]
    confirmed = first(known.where("toxic = 1"), MOST_POSITIVE)
    if not confirmed:
        return None
    # more than are needed, so that those without a label suffice where there are enough; all of bounded number
    some = first(given, 4 * MOST_UNLABELLED)
    ids = lambda x: F.broadcast(spark.createDataFrame([(i,) for i in x], "doc_id long"))
    flags = {r[0]: r[1] for r in known.join(ids(some), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic")).collect()} if some else {}
    loose = sorted((i for i in some if flags.get(i, 0) != 1), key=lambda i: i in flags)[:MOST_UNLABELLED]
    which = [(i, True) for i in confirmed] + [(i, False) for i in loose]
    picked = given.join(F.broadcast(spark.createDataFrame(which, "doc_id long, positive boolean")), "doc_id")
    one = picked.repartition(32, "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("positive", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(pieces, 100_000)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                own = [np.fromiter(features(t, memo), dtype=np.int64) for t in texts]
                at = np.cumsum([0, *map(len, own)])
                flat = pa.array(np.concatenate([*own, np.zeros(0, dtype=np.int64)]))
                like = pa.array([sketches(t) for t in texts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), like], names=["positive", "ids", "like"])

    return materialize(one.mapInArrow(run, "positive boolean, ids array<long>, like array<long>"), "toxic-sample")


def distinct_positives(rows: DataFrame) -> DataFrame:
    """rows with one of each group of confirmed documents that have a sketch in common; the others stay."""
    p = rows.where("positive")
    for k in range(2):
        p = p.groupBy(F.get("like", F.lit(k)).alias("key")).agg(F.min_by(F.struct(*rows.columns), F.get("like", F.lit(1 - k))).alias("row")).select("row.*")
    return p.unionByName(rows.where("not positive"))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> dict | None:
    """Trains on the sample; None where either kind of document is missing."""
    drawn = sample(docs, labels)
    if drawn is None:
        return None
    rows = materialize(distinct_positives(drawn).select("positive", "ids"), "toxic-distinct")
    try:
        n = {r[0]: r[1] for r in rows.groupBy("positive").count().collect()}
        if len(n) < 2:
            return None
        counts = rows.select("positive", F.explode("ids").alias("id")).groupBy("id").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
        # so much more frequent that chance hardly gives it to any of all features: Poisson deviance above the log of their number
        expected = (F.col("u") + 0.5) / n[False] * n[True]
        deviance = F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected)
        often = counts.withColumn("deviance", deviance).where((F.col("p") > LEAST_LIFT * expected) & (F.col("deviance") > math.log(max(1, counts.count()))))
        names = [r[0] for r in often.orderBy(F.desc("deviance"), "id").limit(FEATURES).collect()]
        at = {f: i for i, f in enumerate(names)}
        kept = F.broadcast(rows.sparkSession.createDataFrame([(f, i) for f, i in at.items()], "id long, place int"))
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        found = numbered.select("row", F.explode("ids").alias("id")).join(kept, "id").groupBy("row").agg(F.collect_list("place").alias("places"))
        by = {True: [], False: []}
        for r in numbered.select("row", "positive").join(found, "row", "left").orderBy("positive", F.hash("row"), "row").select("positive", "places").collect():
            by[r[0]].append(r[1] or [])
    finally:
        discard(rows, drawn)

    def matrix(places: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(places), len(names)), dtype=np.float32)
        for r, x in zip(out, places):
            r[x] = 1
        return out

    return train(matrix(by[True]), matrix(by[False]), names, prior)


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """The columns of docs, renamed by place to k0, k1, ..., with score (0 to 1) and predicted."""
    weights, bias = (model or {}).get("weights", {}), (model or {"bias": -40.0})["bias"]
    keep = [f"k{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*keep).withColumn("text", F.col(keep[docs.columns.index("text")]).cast("string"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: tuple(f for f in pieces(w) if f in weights), 300_000)
        for batch in batches:
            for part in slices(batch):
                z = [bias + sum(map(weights.__getitem__, features(t, memo))) for t in part.column(len(keep)).to_pylist()]
                score = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return given.mapInArrow(run, f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score_documents(slim, fit(docs, labels)).select(F.col("k0").alias("doc_id"), F.coalesce(held_out(F.col("k0")), F.lit(False)).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns."""
    return score_documents(docs, fit(docs, labels)).where("predicted = 0").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))
