"""Approximate nearest neighbours by additive quantisation (operator 2).

A vector is its norm times a direction, and a direction is the sum of one
full-dimensional codeword from each codebook. Codebooks are fitted to residuals
by k-means on a bounded sample of directions; encoding keeps the ``BEAM`` best
partial sums from book to book. A code comes with its reconstruction's stored
norm and the vector's own, so that a distance is a sum of table entries; in units of the
query's norm it neither over- nor underflows, whatever the vectors' scales. In each
stretch of ``STRETCH`` vectors a query's ``depth`` best codes are ranked again
by exact distances on the original vectors.

Fitting measures recall: codebooks learn from three quarters of the sample and
search the last quarter, whose true neighbours are known. Books are added until ``DEPTH``
codes hold ``RECALL`` of those neighbours, ``MAX_BOOKS`` at most, and then the depth is
raised as far as that takes.

Queries, in blocks, are held against all blocks of the index, so that no code
goes unscored. A block's rows are bounded by bytes; vectors travel as bytes in their own
type, once for each block of queries. Vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id. Only vectors of equal length are compared;
those not of the sample's most frequent length have no codes and are compared
exactly. Ties go to the smaller id. Repeated rows are candidates of their own,
except that a query never meets a row of its own id; of an id's several rows the one
whose vector comes first in length and then in the order of its bytes asks. A distance that no double can hold is infinite. An empty table gives no rows.
Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, on_executors, smallest_hashes, table
from .vectors import BLOCK_BYTES, as_bytes, distances, item_type, matrix, normalised, norms, valid

#: The codebooks are fitted on at most so many vectors, those with the smallest hashes of their row numbers.
FIT_VECTORS = 16_384
#: Bytes of the vectors that codebooks are fitted on, at most.
FIT_BYTES = 128 << 20
BOOKS, MAX_BOOKS, WORDS, BEAM, ROUNDS = 12, 48, 256, 4, 6
STRETCH, DEPTH, RECALL, MEASURED = 8192, 400, 0.97, 256
#: Vectors in a block of the index that is dealt out so that all cores have one; bytes bound it from above.
LEAST_BLOCK = 8192


@dataclass(frozen=True)
class Codebooks:
    """``words``: (books, words, dimensions) float32, for directions; ``depth``: how many codes of a stretch are ranked again."""

    words: np.ndarray
    depth: int = DEPTH
    recall: float = 1.0

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norms of the reconstructions) of directions, by beam search over the books."""
        books, k, d = self.words.shape
        n = len(x)
        rest = x.astype(np.float32)[:, None, :]
        codes = np.zeros((n, 1, 0), np.int64)
        rows = np.arange(n)[:, None]
        for m, words in enumerate(self.words):
            # |r - c|^2 for the rest r of each partial sum.
            error = (rest.reshape(-1, d) @ (-2 * words.T)).reshape(n, -1, k)
            error += (rest * rest).sum(2)[:, :, None]
            error += (words * words).sum(1)
            error = error.reshape(n, -1)
            keep = min(beam, error.shape[1]) if m < books - 1 else 1
            best = np.empty((n, keep), np.int64)
            for b in range(keep):
                best[:, b] = error.argmin(1)
                error[rows[:, 0], best[:, b]] = np.inf
            rest = rest[rows, best // k] - words[best % k]
            codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None]], 2)
        codes = codes[:, 0]
        sums = sum(self.words[m][codes[:, m]] for m in range(books))
        return codes.astype(np.uint8 if k <= 256 else np.uint16), np.einsum("ij,ij->i", sums, sums)

    def dots(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Dot products of directions with reconstructions, summed from a table for each book."""
        tables = np.einsum("qd,mkd->mqk", x.astype(np.float32), self.words)
        out = np.zeros((len(x), len(codes)), np.float32)
        for m in range(len(tables)):
            out += tables[m][:, codes[:, m]]
        return out


def scores(dots: np.ndarray, squares: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Approximate distances in units of each query's norm ``own``, from dot products of directions and norms ``sizes``."""
    with np.errstate(over="ignore", under="ignore", divide="ignore"):
        t = sizes[None, :] / own[:, None]
        far = np.maximum(t, 1.0)
        near = np.minimum(t, 1.0)
        # t^2 s - 2 t d + 1, divided by t^2 where t is over 1, so that no square overflows.
        return far * np.sqrt(np.maximum(near * near * squares[None, :] - 2 * near / far * dots + 1 / (far * far), 0.0))


def best_codes(score: np.ndarray, depth: int) -> list[np.ndarray]:
    """Each row's ``depth`` columns of least score, ties to the earlier column."""
    if depth >= score.shape[1]:
        return [np.arange(score.shape[1])] * len(score)
    limit = np.partition(score, depth - 1, 1)[:, depth - 1]
    out = []
    for row, most in zip(score, limit, strict=True):
        below = np.flatnonzero(row < most)
        out.append(np.concatenate([below, np.flatnonzero(row == most)[: depth - len(below)]]))
    return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        near = ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])
        sums = np.add.reduceat(np.concatenate([x[order], np.zeros((1, x.shape[1]), x.dtype)]), np.minimum(starts, len(x)), axis=0)
        centres = np.where((count > 0)[:, None], sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(x.dtype)
    return centres


def needed_depth(books: Codebooks, index: np.ndarray, queries: np.ndarray, k: int = 10, recall: float = RECALL) -> int:
    """Codes of a stretch that must be ranked again to find ``recall`` of the queries' ``k`` nearest among ``index``."""
    codes, squares = books.encode(normalised(index))
    sizes, own, found = norms(index), norms(queries), []
    for at in range(0, len(queries), 64):
        part = queries[at : at + 64]
        order = np.argsort(scores(books.dots(normalised(part), codes), squares, sizes, own[at : at + 64]), 1, kind="stable")
        place = np.argsort(order, 1)
        for q in range(len(part)):
            found.append(place[q][np.argsort(distances(index, part[q]), kind="stable")[:k]])
    last = np.sort(np.concatenate(found))[max(0, math.ceil(recall * sum(map(len, found))) - 1)] + 1
    return math.ceil(last * max(1.0, STRETCH / len(index)))


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 5, max_books: int = MAX_BOOKS, depth: int = DEPTH, recall: float = RECALL) -> Codebooks:
    """Codebooks fitted to one residual of directions after another, as many and ranked again as deep as the measured recall asks for."""
    rng, out = np.random.default_rng(seed), []
    order = rng.permutation(len(sample))
    few = len(sample) < 4 * depth
    learn, held = (sample, sample[:0]) if few else (sample[order[: len(sample) * 3 // 4]], sample[order[len(sample) * 3 // 4 :]])
    asked = min(MEASURED, len(held) // 4)
    rest = normalised(learn).astype(np.float32)
    while True:
        for _ in range(books if not out else min(books, max_books - len(out))):
            centres = k_means(rest, words, rounds, rng)
            near = ((centres * centres).sum(1)[None, :] - 2 * rest @ centres.T).argmin(1)
            rest = rest - centres[near]
            out.append(centres)
        found = Codebooks(np.stack(out), depth, recall)
        if few:
            # Too few to measure recall with: all of them are ranked again.
            return Codebooks(found.words, max(depth, len(sample)), recall)
        need = needed_depth(found, held[asked:], held[:asked], recall=recall)
        if need <= depth or len(out) >= max_books:
            return Codebooks(found.words, max(depth, need), recall)


def fit_sample(base: DataFrame, n: int, item: str, limit: int = FIT_VECTORS) -> np.ndarray:
    """At most ``limit`` vectors, and ``FIT_BYTES``, on the driver, all of the length most frequent among them."""
    widest = base.agg(F.max(F.octet_length("v"))).first()[0] or 1
    limit = max(1, min(limit, FIT_BYTES // widest))
    rows = smallest_hashes(base, "row", n, limit, 1).select("v").toPandas()["v"]
    if not len(rows):
        return np.empty((0, 0))
    size = rows.map(len)
    return matrix(rows[size == size.mode().iloc[0]], item)


def row_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, row, size, v): vectors as bytes with a row number, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), as_bytes(part.column(2))], ["vec_id", "size", "v"])

    found = on_executors(vectors).select("vec_id", F.size("embedding").alias("size"), "embedding").mapInArrow(run, "vec_id long, size int, v binary")
    return materialise(found.withColumn("row", F.monotonically_increasing_id()))


def encoded(base: DataFrame, books: Codebooks, item: str) -> DataFrame:
    """(vec_id, row, size, v, codes binary, square, norm): every vector with its code; those of another length have none."""
    size = books.words.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fits = np.flatnonzero(part.column("size").to_numpy() == size)
                codes, square, norm = [None] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                if len(fits):
                    x = matrix(part.column("v").take(pa.array(fits)).to_pylist(), item)
                    got, square[fits] = books.encode(normalised(x))
                    norm[fits] = norms(x)
                    for k, c in zip(fits.tolist(), got, strict=True):
                        codes[k] = c.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes, pa.binary()), pa.array(square), pa.array(norm)], ["vec_id", "row", "size", "v", "codes", "square", "norm"])

    return on_executors(base).select("vec_id", "row", "size", "v").mapInArrow(run, "vec_id long, row long, size int, v binary, codes binary, square double, norm double")


def best_in_block(queries: pd.DataFrame, index: pd.DataFrame, books: Codebooks, k: int, depth: int, item: str, stretch: int = STRETCH) -> pd.DataFrame:
    """Each query's ``k`` nearest by exact distance among its ``depth`` best codes of each stretch of one block."""
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if not len(queries) or not len(index):
        return empty
    out, index = [], index.sort_values(["vec_id", "row"], ignore_index=True)
    x, names = matrix(queries["v"], item), queries["vec_id"].to_numpy()
    coded = bool(index["codes"].notna().all())
    units, own = normalised(x), norms(x)
    for place in np.array_split(np.arange(len(index)), math.ceil(len(index) / stretch)):
        part = index.iloc[place]
        ids, y = part["vec_id"].to_numpy(), matrix(part["v"], item)
        short = coded and len(part) > depth
        if short:
            kind = np.uint8 if books.words.shape[1] <= 256 else np.uint16
            codes = np.frombuffer(b"".join(part["codes"]), kind).reshape(len(part), -1)
            square, norm = part["square"].to_numpy(), part["norm"].to_numpy()
        for at in range(0, len(x), 64):
            some = range(at, min(at + 64, len(x)))
            picks = best_codes(scores(books.dots(units[at : at + 64], codes), square, norm, own[at : at + 64]), depth) if short else [np.arange(len(ids))] * len(some)
            for q, pick in zip(some, picks, strict=True):
                pick = pick[ids[pick] != names[q]]
                distance = distances(y[pick], x[q]) if len(pick) else np.zeros(0)
                order = np.lexsort((ids[pick], distance))[:k]
                out.append(pd.DataFrame({"query_id": names[q], "vec_id": ids[pick][order], "score": distance[order]}))
    found = pd.concat(out, ignore_index=True).sort_values(["query_id", "score", "vec_id"], kind="stable")
    return found.groupby("query_id", sort=False).head(k)


def search(rows: DataFrame, is_query: Column, k: int = 10, depth: int | None = None, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row that ``is_query`` (over vec_id) picks.

    ``depth``: codes of a stretch that are ranked again, in place of what the measured recall asks for;
    ``block``: vectors in a block of the index and at most in a block of queries, in place of ``BLOCK_BYTES``.
    """
    item = item_type(rows, vector_col)
    base = row_vectors(valid(rows, id_col, vector_col))
    n, widest = base.agg(F.count("*"), F.coalesce(F.max(F.octet_length("v")), F.lit(1))).first()
    sample = fit_sample(base, n, item)
    books = fit(sample) if len(sample) else Codebooks(np.zeros((1, 1, 1), np.float32))
    deep = depth or books.depth
    most = block or max(256, BLOCK_BYTES // widest)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / most), 0 if block else min(2 * cores, n // LEAST_BLOCK))
    queries = base.where(is_query).groupBy("vec_id").agg(F.min(F.struct("size", "v")).alias("q")).select("vec_id", "q.size", "q.v")
    groups = max(1, math.ceil(queries.count() / most))
    keys = ["block", "part", "size"]
    asked = queries.select("vec_id", "v", "size", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    told = encoded(base, books, item).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = asked.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(
        lambda a, b: best_in_block(a, b, books, k, deep, item), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found for each vector whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
