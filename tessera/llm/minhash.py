"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Every shingle draws the ranks of a permutation one after another; rank j fills one place of the
signature with j plus a random fraction. A document stops as soon as no later rank can lower a place.
Bands of the signature give candidates; every candidate is confirmed on full shingle sets.

Documents with equal sets are one class and only its first document goes on. In each bucket the
members are first compared with the bucket's smallest one, and what is then linked is merged. Buckets that
hold several components are compared with another member of theirs, a few times. Members of buckets that
still hold several are compared where they have one of their rarest shingles in common, which all pairs at the threshold have (prefix filter); pairs within a component need no answer.
Bands may miss a pair at the threshold with probability 1e-8; the second comparison misses none.

Defined results: a document with fewer words than a shingle has one shingle, its whole sequence; one
without words has none and links with nothing; a row without doc_id links with nothing, has no
component and is kept; rows that repeat a doc_id are each judged by their own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, collect_garbage, discard, materialize, mix, slices, texts_of, windows

ROWS = 4  # of a band
PIVOTS = 3  # comparisons of each open bucket with one of its members


def bands_for(threshold: float, rows: int = ROWS, miss: float = 1e-8) -> int:
    """So many bands that a pair at the threshold is missed with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_sets(texts: list[bytes], size: int, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and how many each has."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    h = np.fromiter((x for w in split for x in map(memo.__getitem__, w)), dtype=np.uint64, count=int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    if len(h) >= size:
        rolled = mix(windows(h, size, 0x9E6C63D0876A9A35))
        whole = doc[: len(rolled)] == doc[size - 1 :]
        hashes, owner = rolled[whole], doc[: len(rolled)][whole]
    else:
        hashes, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):  # the whole sequence, with its length
        own = [np.uint64(xxhash.xxh64_intdigest(b" ".join(split[i]), seed=len(split[i]))) for i in short.tolist()]
        hashes, owner = np.concatenate([hashes, np.array(own, dtype=np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def signatures(hashes: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash: for each set m values, rank and fraction in one integer; a full row of ones for an empty set."""
    docs = len(counts)
    out = np.full(docs * m, 2**64 - 1, dtype=np.uint64)
    owner = np.repeat(np.arange(docs), counts)
    swaps: list[np.ndarray] = []  # what each live element has swapped with at each rank
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(hashes):
                break
            r = mix(hashes, 2 * j + 11)
            k = j + (mix(hashes, 2 * j + 12) % np.uint64(m - j)).astype(np.int64)
            place = k.copy()
            for i in range(j - 1, -1, -1):
                place = np.where(place == swaps[i], i, np.where(place == i, swaps[i], place))
            np.minimum.at(out, owner * m + place, (np.uint64(j) << np.uint64(52)) | (r >> np.uint64(12)))
            highest = (out.reshape(docs, m) >> np.uint64(52)).max(axis=1)
            live = highest[owner] > j  # a later rank can still lower a place
            swaps = [s[live] for s in [*swaps, k]]
            hashes, owner = hashes[live], owner[live]
    return out.reshape(docs, m)


def buckets(sig: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of each signature."""
    with np.errstate(over="ignore"):
        h = np.zeros((len(sig), bands), dtype=np.uint64)
        for r in range(rows):
            h = mix(h + sig[:, r::rows][:, :bands], r)
        return mix(h + np.arange(bands, dtype=np.uint64)[None, :], 99)


def _word_memo() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w, seed=5), 500_000)


def digests(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the whole set) and buckets of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_memo()
        for batch in batches:
            for part in slices(batch):
                hashes, counts = shingle_sets(texts_of(part), size, memo)
                ends = np.cumsum(counts)
                b = buckets(signatures(hashes, counts, bands * ROWS), bands).astype(np.int64)
                own = [xxhash.xxh3_128_digest(hashes[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
                flat = pa.array(b.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(own, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * bands, pa.int32()), flat)],
                    names=["doc_id", "n_shingles", "digest", "buckets"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, buckets array<long>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """node and its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_memo()
        for batch in batches:
            for part in slices(batch):
                hashes, counts = shingle_sets(texts_of(part), size, memo)
                at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.astype(np.int64)))], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b with 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def forests(links: DataFrame) -> DataFrame:
    """Links a, b (a the smaller) of a union-find forest of each batch of links: the same components with fewer links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up: dict[int, int] = {}

            def find(x: int) -> int:
                root = x
                while up.setdefault(root, root) != root:
                    root = up[root]
                while up[x] != root:
                    up[x], x = root, up[x]
                return root

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = sorted((find(a), find(b)))
                up[b] = a
            links_ = [(find(x), x) for x in list(up)]
            a, b = zip(*((r, x) for r, x in links_ if r != x)) if any(r != x for r, x in links_) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, links: DataFrame, hub: int = 2048) -> DataFrame:
    """node and component (its smallest reachable node): union-find within each batch of links, whose forests are then
    joined by spreading labels over their links and jumping to the label of the label, until nothing changes.

    nodes has node; links has a and b. Only nodes of links take part in the rounds, whose number grows with the log of a
    component's diameter. The links of a node with more than `hub` of them are dealt by salts, its label is copied to each."""
    forest = materialize(forests(links), "forest")
    both = forest.union(forest.select("b", "a")).distinct()
    degree = both.groupBy(F.col("b").alias("node")).agg(F.ceil(F.count("*") / hub).cast("int").alias("salts"))
    salts = materialize(degree.where("salts > 1"), "hubs")
    edges = both.join(salts.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    edges = materialize(edges, "edges")
    label = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    label = materialize(label.join(salts, "node", "left").select("node", "label", F.coalesce("salts", F.lit(1)).alias("salts")), "labels")
    while True:
        copies = label.select(F.col("node").alias("b"), "label", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        heard = edges.join(copies, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = materialize(label.join(heard, "node").select("node", F.least("label", "heard").alias("new"), F.col("label").alias("old"), "salts"), "heard")
        own = near.select(F.col("node").alias("new"), F.col("new").alias("further")).where("further < new")
        jump = near.select("new").distinct().join(own, "new")  # only labels that have a lower label themselves
        now = materialize(near.join(jump, "new", "left").select("node", F.coalesce("further", "new").alias("label"), "old", "salts"), "labels")
        changed = now.where("label < old").limit(1).count()
        discard(label, near)
        label = now.select("node", "label", "salts")
        if not changed:
            break
    discard(forest, salts, edges)
    return nodes.join(label.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def candidates_by_smallest(bucketed: DataFrame, percent: int) -> DataFrame:
    """Pairs of each bucket's smallest node with every other one whose size allows the threshold."""
    first = bucketed.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("bucket", F.col("first.node").alias("a"), F.col("first.n_shingles").alias("na"))
    pairs = bucketed.join(first, "bucket").where("node <> a").select("a", F.col("node").alias("b"), "na", F.col("n_shingles").alias("nb"))
    return pairs.where(_sizes(percent)).select("a", "b").distinct()


def _sizes(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def open_rows(bucketed: DataFrame, component: DataFrame) -> DataFrame:
    """bucket, node, n_shingles, component of the buckets that hold several components."""
    known = bucketed.join(component, "node")
    parts = known.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("several")).where("several")
    return known.join(parts.select("bucket"), "bucket", "left_semi")


def candidates_by_pivot(rows: DataFrame, percent: int, salt: int) -> DataFrame:
    """Pairs of one node of each bucket, drawn by a hash, with those of the bucket's other components."""
    pivot = rows.groupBy("bucket").agg(F.min_by(F.struct("node", "n_shingles", "component"), F.xxhash64("node", F.lit(salt))).alias("p"))
    pivot = pivot.select("bucket", F.col("p.node").alias("x"), F.col("p.n_shingles").alias("na"), F.col("p.component").alias("cx"))
    met = rows.select("bucket", F.col("node").alias("y"), F.col("n_shingles").alias("nb"), "component").join(pivot, "bucket").where("component <> cx").where(_sizes(percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


CELLS = 1 << 20


def rarity(sets: DataFrame) -> np.ndarray:
    """How often shingles of each of CELLS hash cells occur: a bounded table that puts all shingles in one order, rare ones first."""
    cell = F.pmod(F.col("shingle"), F.lit(CELLS)).cast("int").alias("cell")
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy(cell).agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n"))
    out = np.zeros(CELLS, dtype=np.int32)
    for batch in counts.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def prefixes(sets: DataFrame, often: np.ndarray, percent: int) -> DataFrame:
    """node, n_shingles, shingle for the rarest shingles of each set: two sets at the threshold have one of these in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, often[flat & (CELLS - 1)], owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = place < np.repeat(n + (-percent * n // 100) + 1, n)  # n - ceil(percent n / 100) + 1
            node = batch.column(0).to_numpy()[owner[first]]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n[owner[first]]), pa.array(flat[order][first])], names=["node", "n_shingles", "shingle"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, n_shingles long, shingle long")


def candidates_left(sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of several components that may still be linked: those that have one of their rarest shingles in common.

    What many documents share is left to the end of every prefix, so a common passage makes no pairs; no pair at the
    threshold is left out. sets are those of the open nodes only."""
    rows = materialize(prefixes(sets, rarity(sets), percent).join(component, "node"), "prefixes")
    mixed = rows.groupBy("shingle").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("shingle")
    rows = rows.join(mixed, "shingle", "left_semi")
    x = rows.select("shingle", F.col("node").alias("a"), F.col("component").alias("cx"), F.col("n_shingles").alias("na"))
    y = rows.select("shingle", F.col("node").alias("b"), F.col("component").alias("cy"), F.col("n_shingles").alias("nb"))
    return x.join(y, "shingle").where("cx <> cy and a < b").where(_sizes(percent)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, made: list | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. made gets the tables that the result still reads."""
    made = [] if made is None else made
    spark, percent = docs.sparkSession, round(100 * threshold)
    bands = bands_for(threshold)
    rows = materialize(digests(docs, size, bands), "digests")
    linkable = rows.where("doc_id is not null and n_shingles > 0")
    classes = materialize(linkable.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    picked = linkable.join(classes, "digest").where("doc_id = node").select("node", "n_shingles", F.explode("buckets").alias("bucket"))
    bucketed = materialize(picked.groupBy("bucket", "node").agg(F.max("n_shingles").alias("n_shingles")), "buckets")
    crowded = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = materialize(bucketed.join(crowded, "bucket", "left_semi"), "shared")
    discard(bucketed)
    involved = shared.select("node").distinct()
    nodes = classes.select("node").distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(involved, "node", "left_semi")
    sets = materialize(sets_of(text, size), "sets")
    collect_garbage(spark)
    links = materialize(confirmed(candidates_by_smallest(shared, percent), sets, percent), "links")
    made += [rows, classes, links]
    merged = lambda: made.append(materialize(components(nodes, links), "components")) or made[-1]
    component = merged()
    for salt in range(PIVOTS):  # most of what a large group still lacks, at one comparison for each member of a bucket
        still = materialize(open_rows(shared, component), "open")
        more = materialize(confirmed(candidates_by_pivot(still, percent, salt), sets, percent), "more")
        made.append(more)
        discard(still)
        if not more.limit(1).count():
            break
        links = links.union(more)
        component = merged()
    still = materialize(open_rows(shared, component).select("node", "component").distinct(), "open")
    if still.limit(1).count():
        of_open = materialize(sets.join(still.select("node"), "node", "left_semi"), "open-sets")
        left = materialize(candidates_left(of_open, still, percent), "left")
        more = materialize(confirmed(left, of_open, percent), "more")
        made.append(more)
        if more.limit(1).count():
            links = links.union(more)
            component = merged()
        discard(of_open, left)
    discard(sets, shared, still)
    whole = classes.join(component, "node").select("digest", "component")
    out = rows.select("doc_id", "n_shingles", F.when(F.expr("doc_id is not null and n_shingles > 0"), F.col("digest")).alias("digest")).join(whole, "digest", "left")
    label = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(F.col("doc_id") == label, F.lit(True)).alias("kept"))


def _gone(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """doc_id of the rows that go, as a table; what it was made from is deleted."""
    made: list[DataFrame] = []
    out = materialize(near_duplicates(docs, size, threshold, made).where("not kept").select("doc_id").distinct(), "gone")
    discard(*made)
    return out


def deduplicate(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs with the first document of each group only.

    Where rows share a doc_id, rows are numbered in the order of doc_id and text and judged by number: each goes or stays
    by its own text, and of equal texts one stays. Rows without doc_id or without words all stay."""
    repeats = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeats:
        gone = _gone(docs, size, threshold)
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = docs.select(F.col("doc_id").cast("long").alias("id"), F.sha2(F.col("text").cast("string"), 256).alias("sha"), F.to_json(row).alias("json"), row.alias("row"))
    order = order.repartitionByRange("id", "sha", "json").sortWithinPartitions("id", "sha", "json")
    number = F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())
    rows = materialize(order.select(number.alias("number"), "row"), "numbered")
    gone = _gone(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), size, threshold).withColumnRenamed("doc_id", "number")
    return rows.join(gone, "number", "left_anti").select("row.*")
