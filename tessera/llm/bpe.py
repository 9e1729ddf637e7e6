"""Byte-level BPE by forced boundaries.

A pair of bytes that stands in no token of the vocabulary can never be merged over, so every place
where such a pair meets is a certain cut. The fragments between cuts are encoded independently, each
distinct one once, and the ids are concatenated. A cut is only used where the splitting pattern that
runs before the merges gives the same pieces on both sides: not after white space (the pattern looks
ahead there), not before an apostrophe (contractions) and not inside a character.

Defined results: null and empty texts have no ids and decode to the empty text; the string of an
added token is its own id wherever it stands, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import Memo, slices, texts_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: What splits a text before the merges of a byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space after white space, or at the start: there the pattern looks ahead. Bytes of wide white space count as such.
DOUBLE_SPACE = re.compile(rb"[\x09-\x0D\x1C-\x20\x85\xA0][ \n]|[\x80-\xBF](?<=\xE1\x9A\x80|\xE2\x80[\x80-\xBF]|\xE2\x81\x9F|\xE3\x80\x80)[ \n]").search


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ForcedBoundaryCodec:
    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {k.encode(): np.uint32(v).tobytes() for k, v in added.items()}
        byte = _byte_of()
        vocab = {i: bytes(byte[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in added}
        vocab |= {i: k.encode() for k, i in added.items()}
        size = max(vocab) + 1
        self.token_bytes = [vocab.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        joined = np.zeros((256, 256), dtype=bool)
        for t in self.token_bytes:
            a = np.frombuffer(t, dtype=np.uint8)
            joined[a[:-1], a[1:]] = True
        cut = ~joined
        cut[[*range(0x09, 0x0E), *range(0x1C, 0x21)], :] = False
        cut[:, 0x27] = False
        cut[:, 0x80:0xC0] = False
        self.cut = cut.reshape(-1)
        solid = [b for b in range(256) if b not in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0)]
        self.spaces_cut = bool(cut[solid][:, [0x20, 0x0A]].all())
        self.ordinary = self._by_rank()
        self.memo, self.spaced = Memo(self._merge, most), Memo(self._spaced, most)

    def boundaries(self, buffer: bytes) -> np.ndarray:
        """Where the certain cuts of a text are."""
        b = np.frombuffer(buffer, dtype=np.uint8)
        if len(b) < 2:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
        wide = at[b[at - 1] >= 0x80]
        if len(wide):  # characters of two or three bytes that may be white space
            lead2, lead3 = b[wide - 2], b[np.maximum(wide - 3, 0)]
            bad = wide[(lead2 == 0xC2) | ((lead3 >= 0xE1) & (lead3 <= 0xE3))]
            at = np.setdiff1d(at, bad, assume_unique=True) if len(bad) else at
        return at

    def _merge(self, fragment: bytes) -> bytes:
        """Ids of a fragment: the splitting pattern and the merges, on it alone."""
        ids = self.ordinary(fragment.decode()) if self.ordinary else self.tokenizer.encode(fragment.decode(), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _by_rank(self):
        """The merges by rank, where the ids of merged tokens follow the order of the merges: the same result, sooner."""
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][t] for t in made]
        if ids != sorted(set(ids)) or any(i >= ids[0] for t, i in model["vocab"].items() if len(t) == 1):
            return None
        ranks = {self.token_bytes[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _spaced(self, word: bytes) -> bytes:
        return self._merge(word if word[:1] == b"\n" else b" " + word)

    def _plain(self, text: bytes) -> bytes:
        if self.spaces_cut and not DOUBLE_SPACE(text):  # every single space and newline is a certain cut
            first, *rest = text.replace(b"\n", b" \n").split(b" ")
            return (self.memo[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))
        cuts = [0, *self.boundaries(text).tolist(), len(text)]
        return b"".join(self.memo[text[i:j]] for i, j in zip(cuts, cuts[1:]) if i < j)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text in UTF-8 its ids as little-endian unsigned 32-bit integers."""
        out = []
        for t in texts:
            runs = [t]  # an added token ends the text before it and starts another
            for token in self.added:
                if token in t:
                    runs = [y for x in runs for y in ([x] if x in self.added else self._split(x, token))]
            out.append(b"".join(self.added[x] if x in self.added else self._plain(x) for x in runs))
        return out

    @staticmethod
    def _split(text: bytes, token: bytes) -> list[bytes]:
        pieces = text.split(token)
        return [y for k, x in enumerate(pieces) for y in ((token, x) if k else (x,))]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character. Unknown ids give nothing."""
        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        i = i[i < len(self.lengths)]
        n = self.lengths[i]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.starts[i] - (ends - n), n) + np.arange(total)
        return self.flat[place].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    """One for each Python worker."""
    return ForcedBoundaryCodec(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch):
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in c.encode(texts_of(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give the empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            text = [c.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text, and decodes its ids, in one pass."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch):
                ids = c.encode(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
