"""Embedding near-dedup by int8 tile products with error bounds (operator 6).

Vectors link if their cosine, in double precision, is 0.95 or more. Unit
vectors are split into an int8 vector with a scale and a rest whose norm is
kept. A tile's int8 products give each cosine up to a bound from those norms:
pairs surely above or below the threshold are settled by it, and only the
others are computed again in double precision. Equal vectors are one node
from the start.

A pair of blocks is one unit of work; a unit returns a row for each linked vector, not its pairs. Vectors
travel as bytes in their own type, once for each block that they are held against. Nodes of clusters lie in cells around pivots,
large cells being cut into blocks, and go only to blocks of
cells that may hold a link of them: by the distance from the plane between two pivots, and
by the cell's radius, both of which are exact bounds. Where a sample shows that such cells would move more than plain blocks, as with vectors without clusters,
there is one cell, and all pairs of its blocks are compared.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are their own component. Vectors of different lengths never
link; bounds serve the length most frequent in the sample that the pivots come from. Repeated rows are copies that link with each other. An empty table gives
no rows. Columns other than the id and the vector are ignored. Rows without an
id are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .additive_quantiser import fit_sample, k_means
from .common import component_labels, join_often, materialise, on_executors, table
from .vectors import BLOCK_BYTES, as_bytes, item_type, matrix, normalised, takes_part, valid

THRESHOLD, TILE = 0.95, 1024
#: At most so many pivots, and about one for so many vectors.
PIVOTS, CELL = 1024, 4096
#: Above what rounding can do to the sums of floats here.
SLACK = 1e-5

def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, scales, norms of what is lost) of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int8 products: floats hold every partial sum of up to 1024 components."""
    return sum(a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T for k in range(0, a.shape[1], 1024))


def linked(x: np.ndarray, y: np.ndarray, qx: tuple, qy: tuple, threshold: float) -> tuple[np.ndarray, int]:
    """(boolean matrix of links, pairs computed again in full precision)."""
    (qa, sa, ea), (qb, sb, eb) = qx, qy
    near = products(qa, qb) * sa.astype(np.float32)[:, None] * sb.astype(np.float32)[None, :]
    worst = eb.max()
    i, j = np.nonzero(near >= (threshold - SLACK - ea - worst - 3 * ea * worst).astype(np.float32)[:, None])
    out = np.zeros(near.shape, bool)
    # |<u,v> - <su qu, sv qv>| <= |eu| |sv qv| + |su qu| |ev| + |eu| |ev|, and |su qu| <= 1 + |eu|.
    bound = ea[i] + eb[j] + 3 * ea[i] * eb[j] + SLACK
    value = near[i, j]
    sure = value - bound >= threshold
    out[i[sure], j[sure]] = True
    maybe = ~sure & (value + bound >= threshold)
    i, j = i[maybe], j[maybe]
    for k in range(0, len(i), 65_536):
        a, b = i[k : k + 65_536], j[k : k + 65_536]
        out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return out, len(i)


def compare(rows: pd.DataFrame, threshold: float, item: str) -> pd.DataFrame:
    """Links between the vectors of one unit: side 0 among themselves, or sides 0 and 1."""
    rows = rows.sort_values(["side", "node"], kind="stable", ignore_index=True)
    node, copies, unit = rows["node"].to_numpy(), rows["copies"].to_numpy(np.float64), normalised(matrix(rows["v"], item))
    q, scale, lost = quantised(unit)
    n, first = len(rows), int((rows["side"] == 0).sum())
    if rows["x"].iloc[0] != rows["y"].iloc[0] and not 0 < first < n:
        # Bounds left one of two blocks without a vector here.
        return pd.DataFrame({"node": node[:0], "links": node[:0], "root": node[:0]})
    links, root = np.zeros(n), np.arange(n)
    a_end, b_start = (first, first) if first < n else (n, 0)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in range(0, a_end, TILE):
        for bt in range(b_start if first < n else at, n, TILE):
            a, b = slice(at, min(at + TILE, a_end)), slice(bt, min(bt + TILE, n))
            hit, _ = linked(unit[a], unit[b], (q[a], scale[a], lost[a]), (q[b], scale[b], lost[b]), threshold)
            if first == n and at == bt:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            links[a] += hit @ copies[b]
            if first < n or at != bt:
                links[b] += hit.T @ copies[a]
            for x, y in meet(hit, at, bt):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
    some = np.flatnonzero(links > 0)
    top = np.array([find(k) for k in some.tolist()], np.int64)
    least = pd.Series(node[some]).groupby(top).transform("min").to_numpy() if len(some) else node[:0]
    return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": least})


def meet(hit: np.ndarray, at: int, bt: int) -> list[tuple[int, int]]:
    """(vector, smallest row of the tile that links reach from it); rows count from ``at``, columns from ``bt``."""
    i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    sub, big = hit[np.ix_(i, j)], np.iinfo(np.int64).max
    row = at + i
    while True:
        column = np.where(sub, row[:, None], big).min(0)
        new = np.minimum(row, np.where(sub, column[None, :], big).min(1))
        if (new == row).all():
            return [*zip((at + i).tolist(), row.tolist(), strict=True), *zip((bt + j).tolist(), column.tolist(), strict=True)]
        row = new


@dataclass(frozen=True)
class Cells:
    """Unit pivots, each cell's first block, number of blocks and radius (an angle), and the angle of the threshold.

    The last cell has no pivot: it holds the vectors of other lengths, which no bound keeps apart.
    """

    pivots: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    radius: np.ndarray
    threshold: float

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell of each unit vector, whether each cell with a pivot may hold a vector linked with it)."""
        near = x @ self.pivots.T
        own = near.argmax(1)
        top = near[np.arange(len(x)), own][:, None]
        # Half the difference of squared distances over the pivots' distance: how far x is from the plane between them.
        apart = np.sqrt(np.maximum(2 - 2 * self.pivots @ self.pivots.T, 0))[own]
        far = top - near > apart * (math.sqrt(max(0.0, 2 - 2 * self.threshold)) + 1e-6) + 1e-9
        outside = np.arccos(np.clip(near, -1, 1)) > self.radius[None, : len(self.pivots)] + math.acos(self.threshold) + 1e-6
        open_to = ~(far | outside)
        open_to[np.arange(len(x)), own] = True
        return own, open_to


def pivots_of(unit: np.ndarray, n: int, k: int, most: int, plain: int, threshold: float, always: bool) -> np.ndarray:
    """``k`` unit pivots, or one where a sample's vectors would go to more blocks by cells than there are plain ones."""
    centres = k_means(unit.astype(np.float32), min(k, len(unit)), 5, np.random.default_rng(3)).astype(np.float64)
    pivots = normalised(np.where(np.abs(centres).max(1, keepdims=True) > 0, centres, unit[:1]))
    near = unit @ pivots.T
    own = near.argmax(1)
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, own, np.arccos(np.clip(near.max(1), -1, 1)))
    blocks = np.ceil(np.bincount(own, minlength=len(pivots)) * n / len(unit) / most)
    _, open_to = Cells(pivots, blocks, blocks, radius, threshold).reach(unit)
    return pivots if always or (open_to * blocks).sum(1).mean() < plain else pivots[:1]


def cell_sizes(nodes: DataFrame, pivots: np.ndarray, item: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, radius) of each cell, the last one for vectors of other lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, least = np.zeros(len(pivots) + 1, np.int64), np.ones(len(pivots) + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fits = part.column("size").to_numpy() == pivots.shape[1]
                count[-1] += (~fits).sum()
                if fits.any():
                    near = normalised(matrix(part.column("v").filter(pa.array(fits)).to_pylist(), item)) @ pivots.T
                    own = near.argmax(1)
                    np.add.at(count, own, 1)
                    np.minimum.at(least, own, near.max(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count), pa.array(least)], ["cell", "n", "least"])

    count, radius = np.zeros(len(pivots) + 1, np.int64), np.zeros(len(pivots) + 1)
    found = nodes.select("size", "v").mapInArrow(run, "cell long, n long, least double").groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    for r in found.collect():  # one row for each cell
        count[r["cell"]], radius[r["cell"]] = r["n"], math.acos(min(1.0, max(-1.0, r["least"])))
    return count, radius


def dealt(nodes: DataFrame, cells: Cells, item: str) -> DataFrame:
    """(x, y, side, size, node, copies, v): each node once for each pair of blocks that may hold a link of it."""
    last = len(cells.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                node = part.column("node").to_numpy()
                own, open_to = np.full(len(node), last), np.zeros((len(node), last + 1), bool)
                open_to[:, last] = True
                fits = np.flatnonzero(part.column("size").to_numpy() == cells.pivots.shape[1])
                if len(fits):
                    own[fits], open_to[fits, :last] = cells.reach(normalised(matrix(part.column("v").take(pa.array(fits)).to_pylist(), item)))
                    open_to[fits, last] = False
                mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                block = cells.first[own] + (mixed % np.maximum(cells.blocks[own], 1).astype(np.uint64)).astype(np.int64)
                row, cell = np.nonzero(open_to & (cells.blocks > 0)[None, :])
                times = cells.blocks[cell]
                row, start = np.repeat(row, times), np.repeat(cells.first[cell], times)
                other = start + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for lo in range(0, len(row), 8192):
                    r, o = row[lo : lo + 8192], other[lo : lo + 8192]
                    b, t = block[r], part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b, o).astype(np.int32)), pa.array(np.maximum(b, o).astype(np.int32)), pa.array((b > o).astype(np.int32)), *(t.column(c) for c in ("size", "node", "copies", "v"))], ["x", "y", "side", "size", "node", "copies", "v"])

    return on_executors(nodes).select("size", "node", "copies", "v").mapInArrow(run, "x int, y int, side int, size int, node long, copies long, v binary")


def vector_nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (vec_id, a, b), nodes (node, a, b, copies, vec_id, size, v)): equal vectors, by 128 bits of hashes, are one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], as_bytes(part.column(4))], ["vec_id", "size", "a", "b", "v"])

    keyed = vectors.select("vec_id", F.size("embedding").alias("size"), F.xxhash64("embedding").alias("a"), F.xxhash64("embedding", F.lit(7)).alias("b"), "embedding")
    rows = materialise(on_executors(keyed).mapInArrow(run, "vec_id long, size int, a long, b long, v binary"))
    nodes = rows.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.any_value("size").alias("size"), F.any_value("v").alias("v"))
    return rows, materialise(nodes.withColumn("node", F.monotonically_increasing_id()))


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, always: bool = False) -> DataFrame:
    """(id, n_links, component_id, kept) for each vector.

    ``block``: vectors in a block, in place of what ``BLOCK_BYTES`` allows; ``cell``: vectors for each pivot; ``always``: cells even where they move more.
    """
    item = item_type(rows, vector_col)
    own, nodes = vector_nodes(valid(rows, id_col, vector_col))
    n, widest = nodes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("v")), F.lit(1))).first()
    sample = fit_sample(nodes.withColumnRenamed("node", "row"), n, item)
    most = block or max(256, BLOCK_BYTES // widest)
    # Enough plain blocks for all cores, or for their bytes.
    plain = max(math.ceil(n / most), min(math.ceil(math.sqrt(4 * rows.sparkSession.sparkContext.defaultParallelism)), n // 1024), 1)
    most = min(most, max(1, math.ceil(n / plain)))
    pivots = pivots_of(normalised(sample), n, min(PIVOTS, max(1, n // cell)), most, plain, threshold, always) if len(sample) else np.ones((1, 1))
    count, radius = cell_sizes(nodes, pivots, item)
    blocks = -(-count // most)
    cells = Cells(pivots, np.cumsum(blocks) - blocks, blocks, radius, threshold)
    total = int(blocks.sum())
    units = total * (total + 1) // 2
    # Enough partitions for what would travel if no bound excluded anything.
    partitions = max(1, min(units, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * total * widest / (64 << 20)))))
    tiles = dealt(nodes, cells, item).repartition(partitions, "x", "y", "size")
    found = materialise(tiles.groupBy("x", "y", "size").applyInPandas(lambda g: compare(g, threshold, item), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = component_labels(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = materialise(
        nodes.select("node", "a", "b", "copies", "vec_id").join(links, "node", "left").join(joined, "node", "left")
        .select("a", "b", "copies", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    )
    least = placed.groupBy("c").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("k"))
    named = materialise(join_often(placed, least, ["c"], "k", n).select("a", "b", "copies", "n_links", "component_id"))
    result = join_often(own.select("vec_id", "a", "b"), named, ["a", "b"], "copies", own.count()).select("vec_id", "n_links", "component_id")
    rest = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{item}>").alias("e")).where("vec_id is not null")
    alone = rest.where(~takes_part(F.col("e"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).select(F.col("vec_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op6_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it is kept, for each row of embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same result from every pair of vectors."""
    return f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v as a join v as b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {threshold}),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a), n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join c on c.a = vec_id left join n on n.a = vec_id"""
