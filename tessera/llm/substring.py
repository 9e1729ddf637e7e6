"""Substring dedup by exact hashes of word windows.

The reference is the corpus itself, in blocks of 20 consecutive words, each indexed by a 128-bit hash with
the document where it occurs first; its place there is not kept. A word is a duplicate if it lies in any
block that occurs earlier, so the duplicate spans are unions of such blocks and have a block's length at
least. Hashes are compared and no text is referenced: this is no relative Lempel-Ziv parse, whose factors
would have to be extended at one place of the reference each.

Blocks are only indexed where they can repeat. Each block has an anchor, the run of 8 words in it with
the smallest hash; an equal block has an equal anchor, so blocks whose anchor occurs once in the corpus
are no candidates. The anchors are a seventh of the words.

Defined results: places are ordered by doc_id, null ids last in the order of a hash of their text, then by start.
Texts of any length are read whole; columns of any name are kept as they are. Rows that share a doc_id
rank equally: a block is earlier only by its start, and equal rows get equal results. A null or empty
text has no words and nothing to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm.common import collect_garbage, keyed, materialize, mix, row_key, slices, texts_of, windows

BLOCK, ANCHOR = 20, 8


#: Bytes of a word that are hashed eight at a time for all words at once; longer words are hashed one by one.
LONG = 64
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # the first n bytes of eight


def _word_hashes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a text whose length is a multiple of 8, with 8 bytes or more after the last word."""
    eights = text.view(np.uint64)

    def read(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Up to eight bytes from any place on, zeros where the word has ended."""
        i, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return ((eights[i] >> bits) | (eights[i + 1] << (np.uint64(63) - bits) << np.uint64(1))) & _LOW[np.minimum(left, 8)]

    h = mix(mix(sizes.astype(np.uint64), 3) ^ read(starts, sizes), 4)
    more, k = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(more):
        h[more] = mix(h[more] ^ read(starts[more] + k, sizes[more] - k), 4)
        k += 8
        more = more[sizes[more] > k]
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(text[starts[i] : starts[i] + sizes[i]], seed=3)
    return h


class Parsed:
    """Word hashes of some texts one after another, with the blocks and anchors that lie within one text."""

    def __init__(self, texts: list[bytes], block: int = BLOCK, anchor: int = ANCHOR):
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        size = int(ends[-1]) if texts else 0
        self.text = np.frombuffer(bytearray(b" ".join([*texts, b" " * (8 + -size % 8)])), dtype=np.uint8)  # a space after each text
        space = (self.text == 0x20) | (self.text - np.uint8(9) < 5)
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.first, self.sizes = edge[::2], edge[1::2] - edge[::2]  # where words begin, and their bytes
        self.counts = np.diff(np.searchsorted(self.first, ends), prepend=0)
        self.starts = np.cumsum(self.counts) - self.counts
        self.h = _word_hashes(self.text, self.first, self.sizes)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        n = max(0, len(self.h) - block + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[block - 1 :]) if n else np.zeros(0, dtype=np.int64)  # where blocks start
        if len(self.at):
            a = mix(windows(self.h, anchor, 0xD6E8FEB86659FD93))
            span = block - anchor + 1
            place, width = np.arange(len(a)), 1  # of the first smallest of a run of `span` anchors, by doubling
            lower = lambda x, y: np.where(a[y] < a[x], y, x)
            while width * 2 <= span:
                place, width = lower(place[:-width], place[width:]), width * 2
            self.place = lower(place[: len(place) - (span - width)], place[span - width :])[self.at]  # where the anchor of each block is
        else:
            self.place = np.zeros(0, dtype=np.int64)
        self.new = np.diff(self.place, prepend=-1) != 0  # neighbours mostly share their anchor
        self.low = a[self.place[self.new]] if len(self.at) else np.zeros(0, dtype=np.uint64)  # the anchors of each run of blocks that share one
        self.low_doc = self.doc[self.at[self.new]]

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of blocks, as two arrays."""
        one = mix(windows(self.h, BLOCK, 0xA0761D6478BD642F))
        two = mix(windows(mix(self.h, 77), BLOCK, 0xE7037ED1A0B428DB), 5)
        return one[which], two[which]

    def kept(self, covered: np.ndarray) -> list[memoryview]:
        """UTF-8 of each text's words that are not covered, joined by one space."""
        first, sizes = self.first[~covered], self.sizes[~covered]
        text = self.text.copy()
        text[first + sizes] = 0x20
        edge = np.zeros(len(text), dtype=np.int8)
        edge[first] = 1
        edge[first + sizes + 1] -= 1  # with the space that follows
        text = text[np.cumsum(edge, dtype=np.int8).view(bool)]
        upto = np.concatenate([[0], np.cumsum(sizes + 1)])
        ends = upto[np.concatenate([[0], np.cumsum(np.bincount(self.doc[~covered], minlength=len(self.counts)))])].tolist()
        whole = memoryview(text)
        return [whole[i : max(i, j - 1)] for i, j in zip(ends, ends[1:])]


def _firsts_of_equal(doc: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The places of the first of equal (doc, one, two). Only those are sorted by all three whose mix occurs again."""
    mixed = one ^ mix(doc.astype(np.uint64), 3)
    low = np.sort(mixed)
    again = np.isin(mixed, low[1:][low[1:] == low[:-1]])
    new = ~again
    order = np.flatnonzero(again)
    order = order[np.lexsort((two[order], one[order], doc[order]))]
    d, x, y = doc[order], one[order], two[order]
    change = np.ones(len(order), dtype=bool)
    change[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    new[order[change]] = True
    return np.flatnonzero(new)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists as uint64, and the row of each."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(counts)), counts)


def _anchors(docs: DataFrame) -> DataFrame:
    """anchor, _key, n (places) of each distinct anchor of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = Parsed(texts_of(part))
                low, doc = p.low, p.low_doc
                order = np.lexsort((low, doc))
                low, doc = low[order], doc[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                place = np.flatnonzero(new)
                n = np.diff(np.append(place, len(doc)))
                key = part.column(part.schema.get_field_index("_key")).to_numpy(zero_copy_only=False)
                rows = doc[place]
                yield pa.RecordBatch.from_arrays([pa.array(low[place].astype(np.int64)), pa.array(key[rows]), pa.array(n.astype(np.int32))], names=["anchor", "_key", "n"])

    return docs.select("text", "_key").mapInArrow(run, "anchor long, _key long, n int")


def _candidates(docs: DataFrame) -> DataFrame:
    """one, two (hash of a block), _key of each block that is open; equal ones of a row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = Parsed(texts_of(part))
                which = _open(p, part.column(part.schema.get_field_index("open")))
                doc, (one, two) = p.doc[which], p.blocks(which)
                new = _firsts_of_equal(doc, one, two)
                key = part.column(part.schema.get_field_index("_key")).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64)), pa.array(key[doc[new]])], names=["one", "two", "_key"])

    return docs.mapInArrow(run, "one long, two long, _key long")


def _marks(p: Parsed, single: pa.Array) -> pa.Array:
    """For each row a bit for each run of blocks that share an anchor: whether it isn't among the row's single ones."""
    flat, owner = _lists(single)
    tagged = lambda value, row: mix(value ^ mix(row.astype(np.uint64), 3), 4)
    runs = np.bincount(p.low_doc, minlength=len(p.counts))
    upto = np.concatenate([[0], np.cumsum((runs + 7) >> 3)])  # bytes of the rows
    bits = np.zeros(8 * int(upto[-1]), dtype=bool)
    bits[_places(runs, upto)] = ~np.isin(tagged(p.low, p.low_doc), tagged(flat, owner))
    return pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(np.packbits(bits))])


def _places(runs: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Where the bits of the runs are, if each row's begin with a byte of their own."""
    return np.arange(int(runs.sum())) + np.repeat(8 * upto[:-1] - (np.cumsum(runs) - runs), runs)


def _open(p: Parsed, marks: pa.Array) -> np.ndarray:
    """Starts of the blocks that _marks() has left open."""
    runs = np.bincount(p.low_doc, minlength=len(p.counts))
    upto = np.concatenate([[0], np.cumsum((runs + 7) >> 3)])
    bits = np.unpackbits(np.frombuffer(b"".join(marks.to_pylist()), dtype=np.uint8)).view(bool)
    return p.at[np.repeat(bits[_places(runs, upto)], np.diff(np.append(np.flatnonzero(p.new), len(p.at))))]


def _covered(p: Parsed, marks: pa.Array, firsts: pa.Array) -> np.ndarray:
    """For each word whether a factor covers it."""
    which = _open(p, marks)
    one, two = p.blocks(which)
    mine, owner = _lists(firsts)
    both, doc = np.concatenate([mine, one ^ two]), np.concatenate([owner, p.doc[which]])  # 64 bits are enough to tell one row's blocks apart
    order = np.lexsort((both, doc))  # of equal ones the row's own firsts come first, then its blocks by start
    both, doc, own = both[order], doc[order], order < len(mine)
    new = np.ones(len(order), dtype=bool)
    new[1:] = (both[1:] != both[:-1]) | (doc[1:] != doc[:-1])
    led = (own & new)[np.flatnonzero(new)][np.cumsum(new) - 1]  # equal to one that the index first has here
    follows = np.zeros(len(order), dtype=bool)
    follows[1:] = own[:-1]
    known = np.ones(len(which), dtype=bool)  # blocks that start earlier elsewhere: all but the first of those
    known[order[led & ~own & follows] - len(mine)] = False
    edge = np.zeros(len(p.h) + 1, dtype=np.int64)
    edge[which[known]] = 1
    edge[which[known] + BLOCK] -= 1  # a block ends within its text
    return np.cumsum(edge)[:-1] > 0


def _runs(p: Parsed, covered: np.ndarray) -> pa.Array:
    """Start and end of each run of covered words, in words of its text, by row."""
    head = np.zeros(len(covered) + 1, dtype=bool)  # where a text begins or ends
    head[p.starts] = head[-1] = True
    padded = np.concatenate([[False], covered, [False]])
    begin, end = np.flatnonzero(padded[1:] & (~padded[:-1] | head)), np.flatnonzero(padded[:-1] & (~padded[1:] | head))
    row = p.doc[begin]
    flat = np.stack([begin - p.starts[row], end - p.starts[row]], axis=1).ravel()
    offsets = np.concatenate([[0], 2 * np.cumsum(np.bincount(row, minlength=len(p.counts)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _judged(docs: DataFrame) -> DataFrame:
    """docs (any columns, text and _key) and open: which runs of blocks may repeat, as bits, since the anchors that occur
    once in the corpus would take 64 bits each in the table and in the shuffle of its rows."""
    once = _anchors(docs).groupBy("anchor").agg(F.sum("n").alias("n"), F.min("_key").alias("_key")).where("n = 1")
    single = once.groupBy("_key").agg(F.collect_list("anchor").alias("single"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at = part.schema.get_field_index("single")
                marks = _marks(Parsed(texts_of(part)), part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], marks], names=[*part.schema.names[:at], "open"])

    return docs.join(single, "_key", "left").select(*docs.columns, "single").mapInArrow(run, StructType([*docs.schema.fields, StructField("open", BinaryType())]))


def parse(docs: DataFrame) -> DataFrame:
    """docs (with _key and _tag) and open, firsts: the blocks that the reference index first has in this document."""
    ready = materialize(_judged(docs), "judged")
    collect_garbage(docs.sparkSession)
    index = _candidates(ready.select("text", "_key", "open")).groupBy("one", "two").agg(F.min("_key").alias("_key"))
    firsts = index.groupBy("_key").agg(F.collect_list(F.col("one").bitwiseXOR(F.col("two"))).alias("firsts"))
    return ready.join(firsts, "_key", "left")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (start and end of each factor, in words) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = Parsed(texts_of(part))
                column = lambda c: part.column(part.schema.get_field_index(c))
                covered = _covered(p, column("open"), column("firsts"))
                gone = np.bincount(p.doc[covered], minlength=part.num_rows)
                sha = [hashlib.sha256(t).hexdigest() for t in p.kept(covered)]
                yield pa.RecordBatch.from_arrays(
                    [column("doc_id"), pa.array(p.counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), _runs(p, covered)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
                )

    return parse(keyed(docs)).select("doc_id", "text", "open", "firsts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, each text with its duplicate spans taken out and n_chars to match; texts without any stay as they are."""
    names = docs.columns
    own = [f"c{k}" for k in range(len(names))]
    kinds = {c: f.dataType.simpleString() for c, f in zip(own, docs.schema.fields)}
    at = own[names.index("text")]
    rest = [c for c in own if c != at]
    given = docs.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, own) if c != at), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = Parsed(texts_of(part))
                column = lambda c: part.column(part.schema.get_field_index(c))
                covered = _covered(p, column("open"), column("firsts"))
                texts, kept, cut = column("text").to_pylist(), p.kept(covered), np.bincount(p.doc[covered], minlength=part.num_rows) > 0
                for r in np.flatnonzero(cut).tolist():
                    texts[r] = str(kept[r], "utf-8")
                yield pa.RecordBatch.from_arrays([*(column(c) for c in rest), pa.array(texts, pa.string()), pa.array(cut)], names=[*rest, "text", "cut"])

    done = parse(row_key(given).drop("doc_id")).select(*rest, "text", "open", "firsts").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "text string", "cut boolean"]))
    out = {n: F.col("text" if c == at else c).alias(n) for n, c in zip(names, own)}
    if "n_chars" in names:
        c = own[names.index("n_chars")]
        out["n_chars"] = F.when(F.col("cut"), F.char_length("text").cast(kinds[c])).otherwise(F.col(c)).alias("n_chars")
    return done.select(*(out[n] for n in names))
