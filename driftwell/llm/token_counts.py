"""Token counts by heap-and-linked-list byte-pair merging (operator 10).

The lowest-rank adjacent pair is popped again and again; the count is the
initial symbols minus the merges, and no identifiers are made. A character
that the vocabulary lacks counts one symbol for each of its UTF-8 bytes.

Null and empty texts have 0 tokens and 0 bytes. Repeated rows give repeated
results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, on_executors, slices, table, text_of

MARK = "▁"


class PieceCounter:
    """Counts the tokens of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only BPE models with byte fallback, no normalisation table and no user-defined pieces are read")
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.prefix = MARK if norm.add_dummy_prefix else ""
        inner = any(MARK in p.lstrip(MARK) for p in self.rank)
        lines = any("\n" in p for p in self.rank if len(p) > 1)
        #: No piece crosses these cuts, so counts can be kept by part.
        self.cut = regex.compile(f"\\n|{MARK}*[^{MARK}\\n]+|{MARK}+").findall if not inner and not lines else lambda text: [text]
        self.cache = BoundedCache(self.part)

    def part(self, text: str) -> int:
        rank, symbols = self.rank, list(text)
        cost = [1 if c in rank else len(c.encode()) for c in symbols]
        count, n = sum(cost), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            count += 1 - cost[i] - cost[j]
            cost[i] = 1
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, len(symbols[i]) + len(symbols[k])))
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] + symbols[i])) is not None:
                heapq.heappush(heap, (r, h, len(symbols[h]) + len(symbols[i])))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.cache.__getitem__, self.cut(self.prefix + text.replace(" ", MARK))))


_loaded: dict[str, PieceCounter] = {}


def loaded(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            for part in slices(batch):
                out = [counter.count(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("t"))
    return on_executors(rows).mapInArrow(run, "id long, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document, and whether they exceed 4096."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
