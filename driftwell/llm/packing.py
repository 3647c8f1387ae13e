"""Best-fit packing with bound-certified repacking (operator 9).

Documents become pieces of at most ``capacity`` tokens. Cells of about
``CELL_PIECES`` pieces are packed side by side by best-fit decreasing. Dual-feasible
functions bound the bins that a cell needs from below: a cell that meets its
bound is certified, and only its emptiest bin goes on; in any other cell every
bin with a gap goes on. What goes on is dealt anew to cells, of twice the
size each round up to ``MAX_CELL`` pieces, and packed again, until one cell holds it, a round of the largest cells saves
less than ``LEAST_SAVED`` of the bins that it packs, or ``ROUNDS`` are over. The same functions over the lengths of all pieces bound the
whole result; ``bound`` is a column of it, so that its gap can be told.

A null or empty text has the end token alone. Repeated rows are packed as
often as they occur, and rows without an id like any other. An empty table gives no rows. Columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse, pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, materialise, on_executors, slices, table, text_of

CELL_PIECES, MAX_CELL, LEAST_SAVED = 4096, 65_536, 1e-4
#: The rounds that a sequence id has bits for. The last keeps whatever it packed.
ROUNDS = 64
#: A stop or comma that ends a part and belongs to a longer run of marks.
MARKS = re.compile(r"(?:[^\w\s]|_)[.,] ")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, no_id boolean, cell int, bin int, offset long, fill long, n_bins int, bound int"


class WordIds:
    """Ids by the tokenizers library, kept by part of a text.

    The vocabulary drops white space before it looks for words, and its other
    normalisers see one character and its combining marks at a time, so that a
    cut at a space or line feed changes no id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.cache = BoundedCache(lambda part: self.ids([part])[0], limit=500_000)

    def ids(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. One call sees all parts with a space between, and offsets tell whose an id is."""
        found = self.lib.encode(" ".join(parts), add_special_tokens=False)
        starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(found))
        ends = np.cumsum([0, *(len(p) + 1 for p in parts)])
        cuts = (4 * np.searchsorted(starts, ends)).tolist()
        raw = np.array(found.ids, "<u4").tobytes()
        return [raw[x:y] for x, y in pairwise(cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cache, split = self.cache, [parts_of(t) for t in texts]
        if len(cache) > cache.limit:
            cache.clear()
        new = [p for p in set(filterfalse(cache.__contains__, chain.from_iterable(split))) if len(p) <= cache.longest]
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            cache.update(zip(part, self.ids(part), strict=True))
        get = cache.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


def parts_of(text: str) -> list[str]:
    """Parts between spaces, made fewer in kind where that changes no id.

    The vocabulary's special strings are matched in the text as it is, before lower-casing, so that a text that
    may hold a variant of one stays as it is.

    In Latin-1, which has no combining marks, the vocabulary's normalisers come down to
    lower case. A stop or comma that follows a letter or digit and ends a part is a word of its own.
    """
    text = text.replace("\n", " ")
    if "<|" in text:
        return text.split(" ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split(" ")
    text = text.lower() + " "
    if not MARKS.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


_loaded: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    """One vocabulary and cache for each Python worker, whatever tasks it runs."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def cut_pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document: its ids and the end token, cut only if longer than ``capacity``."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path)
        for batch in batches:
            for part in slices(batch, 256):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return on_executors(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Bins that no packing can do without, by dual-feasible functions; each length counts ``times`` times.

    Sums of sizes; for each threshold t up to half of the capacity, sizes over capacity - t count as a
    whole bin and those below t as nothing; and for each k, the rounding
    function that maps x to x if x (k + 1) / capacity is whole, else to its
    whole part over k.
    """
    if not len(lengths):
        return 0
    x, n = np.unique(np.asarray(lengths, np.int64), return_counts=True) if times is None else (np.sort(lengths), times[np.argsort(lengths)])
    best = -(-int((x * n).sum()) // capacity)
    total, items = np.cumsum(x * n), np.cumsum(n)
    for t in np.unique(np.concatenate([x[x <= capacity // 2], [capacity // 2]])):
        lo, hi = np.searchsorted(x, t), np.searchsorted(x, capacity - t, side="right")
        whole = int(items[-1] - (items[hi - 1] if hi else 0))
        middle = int((total[hi - 1] if hi else 0) - (total[lo - 1] if lo else 0)) if hi > lo else 0
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 33):
        y = x * (k + 1)
        exact = y % capacity == 0
        # in units of 1 / (k * capacity)
        u = np.where(exact, x * k, (y // capacity) * capacity)
        best = max(best, -(-int((u * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first, and each bin's fill.

    Bit r of ``open_bits`` is set if some bin has r tokens left, so that the tightest fit is
    one shift and one lowest set bit away.
    """
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        if at := open_bits >> size:
            room = size + (at & -at).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_bits &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        if left := room - size:
            by_room[left].append(b)
            open_bits |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def pack_cells(pieces: DataFrame, cells: int, seed: int, capacity: int) -> DataFrame:
    """Each cell packed by itself, with its bin count and lower bound. A missing id is 0 with ``no_id``, for a null would make pandas' ids floats."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        return rows.assign(bin=bins.astype("int32"), offset=offsets, fill=fill[bins], n_bins=np.int32(len(fill)), bound=np.int32(lower_bound(lengths, capacity)))

    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed), F.col("salt")), F.lit(cells)).cast("int")
    # Equal rows must not meet in one cell just because they are equal: the salt deals them out.
    dealt = pieces.withColumn("salt", F.floor(F.rand(seed) * 1_000_003)).withColumn("cell", cell).drop("salt")
    return on_executors(dealt).groupBy("cell").applyInPandas(pack, PACKED)


def total_bound(pieces: DataFrame, capacity: int) -> int:
    """The sequences that no packing of all pieces can do without, from the counts of their at most ``capacity`` lengths."""
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    return lower_bound(counts["length"].to_numpy(np.int64), capacity, counts["n"].to_numpy(np.int64))


def pack(pieces: DataFrame, capacity: int = 4096, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """(piece columns, sequence_id, offset, bound): every piece placed in a sequence of ``capacity``; ``bound`` is that of all pieces."""
    own = ["doc_id", "piece", "start", "length", "ids_crc32", "no_id"]
    todo = materialise(pieces.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).select(*own))
    done, before, bound = [], None, total_bound(todo, capacity)
    for k in range(ROUNDS):
        size = min(cell_pieces << k, max(MAX_CELL, cell_pieces))
        cells = max(1, math.ceil(todo.count() / size))
        packed = materialise(pack_cells(todo, cells, 17 + k, capacity)).withColumn("sequence_id", F.expr(f"{k}L * (1L << 57) + cell * (1L << 24) + bin"))
        bins = packed.groupBy("cell", "bin").agg(F.max("fill").alias("fill"), F.max("n_bins").alias("n_bins"), F.max("bound").alias("bound"))
        if cells == 1 or k == ROUNDS - 1 or size >= MAX_CELL and before is not None and before - bins.count() < max(1, before * LEAST_SAVED):
            done.append(packed)
            break
        emptiest = bins.groupBy("cell").agg(F.min_by("bin", F.struct("fill", "bin")).alias("least"))
        going = (
            bins.join(emptiest, "cell")
            .where((F.col("fill") < capacity) & ((F.col("n_bins") > F.col("bound")) | (F.col("bin") == F.col("least"))))
            .select("cell", "bin", F.lit(True).alias("goes"))
        )
        split = materialise(packed.join(going, ["cell", "bin"], "left"))
        done.append(split.where("goes is null"))
        todo = split.where("goes").select(*own)
        before = going.count()
    columns = [F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.lit(bound).cast("long").alias("bound")]
    out = done[0].select(*columns)
    for more in done[1:]:
        out = out.unionByName(more.select(*columns))
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(cut_pieces(docs, path, 1, capacity, id_col, text_col), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
