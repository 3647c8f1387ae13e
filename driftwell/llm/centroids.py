"""Centroid clustering over subvector dictionaries (operator 13).

Components become integers, and vectors are gathered into tiles of at most
``TILE`` rows. In a tile each block of ``BLOCK`` dimensions is
dictionary-encoded without loss: its distinct subvectors, and a code of two
bytes for each vector. A round works out the exact squared distance of every
distinct subvector from every centroid's part once, sums these partial
distances by code, and takes each vector's nearest centroid. New centroids
follow from how often each code occurs in a cluster. Tiles are encoded once
and written; a round passes only sums for each centroid and dimension to the
driver, so that nothing there grows with the vectors, and no vector is
shuffled.

Vectors that are null, of another length, or hold a null or non-finite
component take no part. Zero vectors do. A vector without an id is clustered,
but is never a first centroid; of rows with one id the smaller vector comes
first. With fewer usable vectors than centroids there are fewer centroids; an
empty table, or one whose usable vectors all lack ids, gives no rows. Repeated rows give repeated results. Integers are
exact whatever their size: components beyond ``LIMIT`` are kept as Python
integers. A distance or a sum of distances that no 64-bit number holds is
given as the largest one. Columns other than the id and the vector are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, on_executors, table
from .vectors import components

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Dimensions of a block: two of these integers take few distinct values together, so that a dictionary is much shorter than its tile.
BLOCK = 2
#: Vectors of a tile; codes take two bytes.
TILE = 1 << 15
#: Up to here squared distances over 64 dimensions fit 64 bits.
LIMIT = 1 << 27
LONGEST = (1 << 63) - 1
#: Bits of a part of a sum on its way through Spark.
PART = 32

ENCODED = "ids array<long>, wide boolean, sizes array<int>, words binary, codes binary"


def usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def whole(x: float) -> int:
    """floor(256 x), exactly."""
    return math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE


@dataclass
class Tile:
    """Dictionaries of distinct subvectors and each vector's codes, by block."""

    words: list[np.ndarray]
    codes: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray, block: int) -> Tile:
        words, codes = [], np.empty((-(-values.shape[1] // block), len(values)), np.uint16)
        for b in range(len(codes)):
            part = values[:, b * block : (b + 1) * block]
            if part.dtype == object:
                known = {w: k for k, w in enumerate(sorted(set(map(tuple, part.tolist()))))}
                codes[b] = [known[tuple(w)] for w in part.tolist()]
                words.append(np.array(list(known), object).reshape(len(known), -1))
            else:
                part = np.ascontiguousarray(part, np.int32)
                # Two components sort far faster as one number.
                found, codes[b] = np.unique(part.view(np.int64).ravel(), return_inverse=True) if part.shape[1] == 2 else np.unique(part, axis=0, return_inverse=True)
                words.append(found.view(np.int32).reshape(len(found), -1))
        return cls(words, codes)

    def values(self) -> np.ndarray:
        """The vectors again."""
        return np.concatenate([w[c] for w, c in zip(self.words, self.codes, strict=True)], axis=1)

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector; ties go to the smaller number."""
        exact = any(w.dtype == object for w in self.words) or any(abs(x) > LIMIT for c in centroids for x in c)
        kind = object if exact else np.int64
        rows, at = np.array(centroids, kind), 0
        total = np.zeros((self.codes.shape[1], len(rows)), kind)
        for words, codes in zip(self.words, self.codes, strict=True):
            away = words.astype(kind)[:, None, :] - rows[None, :, at : at + words.shape[1]]
            total += (away * away).sum(2)[codes]
            at += words.shape[1]
        near = total.argmin(1)
        return near, total[np.arange(len(near)), near]

    def sums(self, near: np.ndarray, k: int) -> np.ndarray:
        """(centroid, dimension): the sums of the vectors nearest to each, from how often each code occurs."""
        out = []
        for words, codes in zip(self.words, self.codes, strict=True):
            kind = object if words.dtype == object else np.int64
            often = np.bincount(near.astype(np.int64) * len(words) + codes, minlength=k * len(words)).reshape(k, len(words))
            out.append(often.astype(kind) @ words.astype(kind))
        return np.concatenate(out, axis=1)


def packed(ids: pa.Array, values: np.ndarray, block: int) -> pa.RecordBatch:
    """A tile as one row of ``ENCODED``."""
    tile = Tile.encode(values, block)
    wide = values.dtype == object
    words = ",".join(str(x) for w in tile.words for x in w.ravel()).encode() if wide else b"".join(w.astype("<i4").tobytes() for w in tile.words)
    row_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays(
        [row_ids, pa.array([wide]), pa.array([[len(w) for w in tile.words]], pa.list_(pa.int32())), pa.array([words], pa.binary()), pa.array([tile.codes.astype("<u2").tobytes()], pa.binary())],
        ["ids", "wide", "sizes", "words", "codes"],
    )


def unpacked(batches: Iterator[pa.RecordBatch], dims: int, block: int) -> Iterator[tuple[pa.Array, Tile]]:
    """(ids, tile) of each row of ``ENCODED``."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, wide, sizes, words, codes = (batch.column(name)[k] for name in ("ids", "wide", "sizes", "words", "codes"))
            raw = words.as_buffer()
            flat = np.array([int(x) for x in raw.to_pybytes().decode().split(",")], object) if wide.as_py() else np.frombuffer(raw, "<i4")
            found, at = [], 0
            for b, n in enumerate(sizes.as_py()):
                width = min(block, dims - b * block)
                found.append(flat[at : at + n * width].reshape(n, width))
                at += n * width
            yield ids.values, Tile(found, np.frombuffer(codes.as_buffer(), "<u2").reshape(len(found), -1))


def tiles(rows: DataFrame, dims: int, block: int) -> DataFrame:
    """``ENCODED`` tiles of rows (vec_id long, embedding array<double>); vectors with a component beyond ``LIMIT`` have tiles of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield packed(pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held]), block)
                held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                x = components(part.column(1))[0].reshape(-1, dims)
                with np.errstate(over="ignore"):
                    scaled = np.floor(x * SCALE)
                narrow = (np.abs(scaled) <= LIMIT).all(1)
                if not narrow.all():
                    exact = np.array([[whole(v) for v in row] for row in x[~narrow].tolist()], object).reshape(-1, dims)
                    yield packed(part.column(0).filter(pa.array(~narrow)), exact, block)
                if narrow.any():
                    if sum(len(v) for _, v in held) + int(narrow.sum()) > TILE:
                        yield from flush()
                    held.append((part.column(0).filter(pa.array(narrow)), scaled[narrow].astype(np.int32)))
        yield from flush()

    return on_executors(rows.select("vec_id", "embedding")).mapInArrow(run, ENCODED)


def parts_of(x: int) -> list[int]:
    """Signed parts whose shifted sum is ``x``; one part where it fits."""
    if abs(x) < 1 << 62:
        return [x]
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x:
        out.append(sign * (x & ((1 << PART) - 1)))
        x >>= PART
    return out


def moved(encoded: DataFrame, centroids: list[list[int]], dims: int, block: int) -> list[list[int]]:
    """The centroids after one round: each cluster's componentwise floor of sum / count; empty ones stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for _, tile in unpacked(batches, dims, block):
            near, _ = tile.nearest(centroids)
            sums = sums + tile.sums(near, k)
            counts += np.bincount(near.astype(np.int64), minlength=k)
        # Dimension -1 holds the count.
        rows = [(c, -1, 0, int(counts[c])) for c in range(k) if counts[c]]
        rows += [(c, d, p, v) for c in range(k) if counts[c] for d in range(dims) for p, v in enumerate(parts_of(int(sums[c, d])))]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "dim", "part", "value"])

    totals = encoded.mapInArrow(run, "cluster int, dim int, part int, value long").groupBy("cluster", "dim", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    # At most (dims + 1) rows a centroid, times the parts of huge sums.
    found: dict[tuple[int, int], int] = {}
    for r in totals.collect():
        found[r["cluster"], r["dim"]] = found.get((r["cluster"], r["dim"]), 0) + (int(r["value"]) << PART * r["part"])
    return [[found[c, d] // found[c, -1] for d in range(dims)] if (c, -1) in found else old for c, old in enumerate(centroids)]


def assigned(encoded: DataFrame, centroids: list[list[int]], dims: int, block: int) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tile in unpacked(batches, dims, block):
            near, far = tile.nearest(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(np.minimum(far, LONGEST).astype(np.int64))], ["vec_id", "cluster", "distance"])

    return encoded.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(rows: DataFrame, k: int, prefix: str) -> list[list[int]]:
    """The vectors of the ``k`` smallest hashes of their ids, in that order."""
    hashed = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    return [[whole(x) for x in r["embedding"]] for r in hashed.orderBy("h", "embedding").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, prefix: str = "2:", block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector.

    ``distance`` is squared; the inertias are its sums over the cluster and over all vectors.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = own.where(usable(F.col("embedding"), dims))
    centroids = first_centroids(rows, k, prefix)
    encoded = materialise(tiles(rows, dims, block))
    if centroids:
        for _ in range(rounds):
            centroids = moved(encoded, centroids, dims, block)
    else:
        # Only vectors without ids, or none at all: nothing to be near to.
        encoded = encoded.limit(0)
    near = materialise(assigned(encoded, centroids, dims, block))
    inertia = {r["cluster"]: int(r["d"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(LONGEST, sum(inertia.values()))
    told = [(c, min(LONGEST, d), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    facts = near.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each centroid.
    return near.join(F.broadcast(facts), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster after five rounds, with distances and the centroids' digests."""
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, prefix: str = "2:") -> str:
    """The same from every vector's distance to every centroid."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select r, c, d from (select v.r, c{i}.c, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{i})
  qualify row_number() over (partition by r order by d, c) = 1)""")
        if i < rounds:
            steps.append(f"""n{i} as (select c, list(((s - (s % n + n) % n) // n)::bigint order by p) as q from (select c, p, sum(x) as s, count(*) as n from (select c, unnest(q) as x, unnest(range({dims})) as p from a{i} join v using (r)) group by c, p) group by c),
c{i + 1} as materialized (select c, coalesce(n{i}.q, c{i}.q) as q from c{i} left join n{i} using (c))""")
    return f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {dims}),
c0 as materialized (select row_number() over (order by sha256('{prefix}' || vec_id), q) - 1 as c, q from v where vec_id is not null qualify c < {k}),
{", ".join(steps)}
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c{rounds}.q, ',')) as centroid_sha256
from a{rounds} join v using (r) join c{rounds} using (c)"""
