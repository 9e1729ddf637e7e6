"""Bound-certified best-fit packing of documents into sequences.

Pieces are dealt over partitions, each of which runs best-fit decreasing and computes a lower bound on
its sequences from dual-feasible functions. A partition that meets its bound is certified and final.
The others keep their full sequences and exchange the pieces of the rest: these are dealt anew among
all partitions with a gap and packed again, until all are certified, two exchanges in a row have not
lowered the count, or six rounds are over.

Defined results: a null or empty text is one piece of its end token; repeated rows are packed each;
an empty table gives no rows; columns but doc_id and text are not looked at. A document longer than the
capacity is cut so that its first piece takes what is left over, into any number of pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import codec, default_path
from tessera.llm.common import discard, materialize, slices, texts_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. The tightest open bin is found in a bit set of the free spaces."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fits := free >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                free ^= 1 << room
        else:
            b, room, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            open_at[room - size].append(b)
            free |= 1 << (room - size)
    return bins, offsets, made


def dual_bound(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for counts[s] items of size s: the best of two families of dual-feasible functions."""
    sizes = np.flatnonzero(counts)
    n = counts[sizes].astype(object)
    best = math.ceil(Fraction(int((sizes * counts[sizes]).sum()), capacity))
    for k in range(1, 21):  # rounds (k + 1) x down to multiples of 1 / k unless it is whole
        whole = (sizes * (k + 1)) % capacity == 0
        value = np.where(whole, sizes * k, (sizes * (k + 1)) // capacity * capacity)
        best = max(best, math.ceil(Fraction(int((value.astype(object) * n).sum()), capacity * k)))
    for small in np.unique(sizes[sizes * 2 <= capacity]).tolist():  # large items count whole, small ones not at all
        value = np.where(sizes > capacity - small, capacity, np.where(sizes >= small, sizes, 0))
        best = max(best, math.ceil(Fraction(int((value.astype(object) * n).sum()), capacity)))
    return best


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((s, capacity) for s in range(first, length, capacity))]


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """A row for each piece of each document's ids with the end token."""
    path, end = path or default_path(), np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for d, ids in zip(part.column(0).to_pylist(), c.encode(texts_of(part))):
                    ids += end
                    rows += [(d, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES)


def _packed(pieces: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """pieces with group, bin, offset, fill (of the bin) and gap (bins of the group above its bound)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        n = pdf["length"].to_numpy()
        bins, offsets, made = best_fit_decreasing(n, capacity)
        fill = np.bincount(bins, weights=n, minlength=made).astype(np.int64)
        return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], gap=made - dual_bound(np.bincount(n, minlength=capacity + 1), capacity))

    # eight rounds at most and fewer than 2**32 groups each: no two groups share a number
    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("group", F.lit(salt * 2**32) + F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(one, f"{PIECES}, group long, bin long, offset long, fill long, gap long")


def _bins(df: DataFrame) -> int:
    """How many bins: each has one piece that starts it."""
    return df.where("offset = 0").count()


def pack(pieces: DataFrame, capacity: int = 1024, per_partition: int = 16384, rounds: int = 6) -> DataFrame:
    """pieces with sequence_id, offset and certified (their partition met its bound).

    pieces must be a table that can be read again. A task holds about per_partition pieces."""
    if not 1 <= rounds <= 8:
        raise ValueError("one to eight rounds")
    done: list[DataFrame] = []
    todo, total = pieces, pieces.count()
    best, idle = None, 0  # packing of what is still open; exchanges in a row that have lowered nothing
    for k in range(rounds):
        new = materialize(_packed(todo, max(1, math.ceil(total / per_partition)), k, capacity), f"packing-{k}")
        if best is not None and _bins(new) >= _bins(best):
            discard(new)  # the packing before it stands; the same pieces are dealt once more with another salt
            idle += 1
            if idle == 2:
                break
            continue
        if best is not None:
            done.pop()
        idle = 0
        final, best = new.where(f"gap = 0 or fill = {capacity}"), new.where(f"gap > 0 and fill < {capacity}")
        done += [final, best]
        todo, total = best, best.count()
        if not total or new.select(F.max("group") == F.min("group")).first()[0]:
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("group") * 2**28 + F.col("bin")).alias("sequence_id"), "offset", (F.col("gap") == 0).alias("certified"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, per_partition: int = 16384) -> DataFrame:
    return pack(materialize(token_pieces(docs, capacity, end_id, path), "pieces"), capacity, per_partition)


def sequences(docs: DataFrame, packed: DataFrame, end_id: int = 2, path: str | None = None) -> DataFrame:
    """sequence_id and its ids: the packed token sequences themselves. doc_id has to be unique and not null."""
    from tessera.llm.bpe import encode_documents

    ids = encode_documents(docs, path).withColumn("ids", F.concat("ids", F.array(F.lit(end_id))))
    parts = packed.join(ids, "doc_id").select("sequence_id", F.struct("offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("part"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))
