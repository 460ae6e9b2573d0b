"""What the two operators on embeddings share: which vectors take part, and Arrow columns as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Whether an array of doubles is neither null, empty nor zero and has only finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0.0), F.lit(False))


def one_per_id(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id long, vec array<double> (null where unusable). Of rows with the same id the smallest usable vector counts;
    rows without id are left out. Vectors may differ in length; only those of one length are ever compared."""
    raw = F.col(f"`{embedding}`")
    if df.select(raw).schema[0].dataType.simpleString() != "array<float>":  # half the bytes to move
        raw = raw.cast("array<double>")
    d = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(usable(raw), raw).alias("vec")).where("vec_id is not null")
    return d.groupBy("vec_id").agg(F.min("vec").cast("array<double>").alias("vec"))


def by_length(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of an Arrow column of lists: each length, the places of its vectors, and those as rows of a matrix."""
    column = _whole(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        if length:
            yield int(length), at, matrix(column.take(pa.array(at)))


def _whole(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists of doubles as rows of a matrix."""
    column = _whole(column)
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as bytes: four a component where those hold every one, else eight."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    x = np.ascontiguousarray(single if (single == x).all() else x.astype("<f8"))
    offsets = np.arange(len(x) + 1, dtype=np.int64) * x.shape[1] * x.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary())


def unpacked(column, length: int) -> np.ndarray:
    """Such bytes as rows of a matrix."""
    column = _whole(column)
    sizes, out = pc.binary_length(column).to_numpy(zero_copy_only=False), np.zeros((len(column), length))
    for kind in ("<f4", "<f8"):
        at = np.flatnonzero(sizes == length * np.dtype(kind).itemsize)
        if len(at):
            data = column.take(pa.array(at))
            out[at] = np.frombuffer(data.buffers()[2], kind, count=len(at) * length).reshape(len(at), length)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length, without overflow."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
