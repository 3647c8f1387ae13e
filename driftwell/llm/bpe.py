"""BPE encoding and decoding by a contiguous rank array (operator 4).

A short word is a list of parts and a list of the ranks of adjacent parts:
the smallest rank is found by scanning, its boundary deleted, and the two
neighbouring ranks refreshed. Words of over ``LONG_WORD`` bytes, where
repeated scans would cost the square of the length, take the same merges
from a heap over a linked list.

Null texts count as empty; an empty text has no ids and decodes to an empty
text. Repeated rows give repeated results; columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, on_executors, slices, table, text_of

LONG_WORD = 200
#: What the vocabulary's pattern calls white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Cuts a text where no word of the pattern crosses, so that results can be kept by piece.
PIECES = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    shifted = {b: chr(256 + k) for k, b in enumerate(rest)}
    return [shifted.get(b, chr(b)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder for a byte-level BPE vocabulary in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])}
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * self.size
        for token, k in vocab.items():
            self.bytes[k] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, k in self.special.items():
            self.bytes[k] = content.encode()
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cache = BoundedCache(self.piece)

    def short(self, word: bytes) -> list[int]:
        none = 1 << 60
        pairs, parts = self.pairs, [self.first[b] for b in word]
        ranks = [pairs.get(p, (none, 0))[0] for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i] = pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), (none, 0))[0]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), (none, 0))[0]
        return parts

    def long(self, word: bytes) -> list[int]:
        pairs, parts = self.pairs, [self.first[b] for b in word]
        n = len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(pairs[p][0], i, pairs[p][1], *p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = made, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (got := pairs.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (got[0], x, got[1], parts[x], parts[y]))
        return [p for p, dead in zip(parts, gone) if not dead]

    def piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for word in self.words.findall(piece):
            raw = word.encode()
            ids += self.short(raw) if len(raw) <= LONG_WORD else self.long(raw)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.marks is None or "<" not in text:
            return b"".join(map(self.cache.__getitem__, PIECES.findall(text)))
        out = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.cache.__getitem__, PIECES.findall(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text for ids as ``encode`` gives them."""
        raw = b"".join(map(self.bytes.__getitem__, array("I", ids)))
        return raw.decode("utf-8", "replace").encode()


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One vocabulary for each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): ids of each whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in slices(batch):
                out = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return on_executors(rows).mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; a null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in slices(batch):
                out = [bpe.decode(x).decode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.coalesce(ids_col, F.lit(b"")).alias("ids"))
    return on_executors(rows).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded string): encode and decode in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in slices(batch):
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                text = [bpe.decode(x).decode() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return on_executors(rows).mapInArrow(run, "id long, ids binary, decoded string").withColumnRenamed("id", id_col)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for each document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
