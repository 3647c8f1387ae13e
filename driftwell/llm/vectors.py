"""What the vector operators share: which vectors take part, their bytes, and measures that neither over- nor underflow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Bytes of vectors in one block.
BLOCK_BYTES = 8 << 20


def takes_part(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def item_type(rows: DataFrame, vector_col: str) -> str:
    """float where the components are floats, so that nothing is lost, else double."""
    kind = rows.schema[vector_col].dataType
    return "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, embedding array of ``item_type``) of the rows that take part."""
    kind = item_type(rows, vector_col)
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
    return own.where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))


def components(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all components in a row, where each vector starts, and the end) of an Arrow column of vectors without nulls."""
    starts = column.offsets.to_numpy()
    return column.values.to_numpy()[starts[0] : starts[-1]], starts - starts[0]


def as_bytes(column: pa.ListArray) -> pa.Array:
    """Each vector's components as bytes, which Arrow and numpy pass on without a copy for each component."""
    flat, starts = components(column)
    raw = flat.astype(flat.dtype.newbyteorder("<"), copy=False)
    offsets = (starts * flat.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def matrix(vectors, item: str) -> np.ndarray:
    """Vectors of equal length, given as bytes, as a matrix of doubles."""
    if not len(vectors):
        return np.empty((0, 0))
    return np.frombuffer(b"".join(vectors), "<f4" if item == "float" else "<f8").reshape(len(vectors), -1).astype(np.float64)


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms; scaled first where squares over- or underflow."""
    with np.errstate(over="ignore", under="ignore"):
        plain = np.sqrt(np.einsum("ij,ij->i", x, x))
        odd = ~((plain > 1e-140) & (plain < 1e150))
        if odd.any():
            top = np.abs(x[odd]).max(1)
            plain[odd] = top * np.sqrt(((x[odd] / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))
    return plain


def normalised(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``y`` from ``x``; infinite only where no double can hold them."""
    with np.errstate(over="ignore", under="ignore"):
        plain = np.sqrt(((y - x) ** 2).sum(1))
        odd = ~((plain > 1e-140) & (plain < 1e150))
        if odd.any():
            top = np.maximum(np.abs(y[odd]).max(1), np.abs(x).max())[:, None]
            plain[odd] = top[:, 0] * np.sqrt(((y[odd] / top - x / top) ** 2).sum(1))
    return plain
