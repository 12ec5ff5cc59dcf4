"""Vectors as packed doubles, shared by the two vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from segmentflow.llm.columns import column as named


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_key, vec): vec is the vector as packed doubles; null if it is null, empty, zero or not all finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                values = batch.column(1)[i].values
                v = None if values is None or values.null_count else values.to_numpy(zero_copy_only=False)
                ok = v is not None and len(v) and np.isfinite(v).all() and np.any(v)
                out.append(v.astype("<f8").tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_key", "vec"])

    chosen = vectors.select(named(id_col).alias("vec_key"), named(vector_col).cast("array<double>").alias("values"))
    return chosen.mapInArrow(run, T.StructType([chosen.schema["vec_key"], T.StructField("vec", T.BinaryType())]))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long packed vectors."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)


def exponents(v: np.ndarray) -> np.ndarray:
    """Per row the power of two above its largest component."""
    return np.frexp(np.abs(v).max(axis=1))[1]


def units(v: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; scaled by a power of two first, so that no square overflows or vanishes."""
    v = np.ldexp(v, -exponents(v)[:, None])
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
