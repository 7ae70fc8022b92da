"""Embedding vectors as rows of numbers: which take part, and one row for all exact copies."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed(column: pa.Array, dtype: str) -> np.ndarray | None:
    """Rows of a binary column as rows of numbers, without a copy; None if they differ in length."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    sizes = np.diff(ends)
    if not len(sizes) or (sizes != sizes[0]).any():
        return None
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(column), -1)


def numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, digest (128 bits of the values), v (the values as doubles, binary), dim.

    Vectors that are null, empty, all zero or hold a null or non-finite component get nulls there and take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, v, dim = [], [], []
            for x in batch.column(1):
                row = None
                if x.is_valid and len(x) and x.values.null_count == 0:
                    row = x.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    row = row if np.isfinite(row).all() and row.any() else None
                data = None if row is None else row.tobytes()
                digest.append(data and hashlib.blake2b(data, digest_size=16).digest())
                v.append(data)
                dim.append(None if row is None else len(row))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(v, pa.binary()), pa.array(dim, pa.int32())], names=["vec_id", "digest", "v", "dim"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, digest binary, v binary, dim int")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """From ``numbers``: digest, rep (smallest vec_id), copies, v, dim; rows with null ids or without a vector left out."""
    return rows.filter("digest IS NOT NULL AND vec_id IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("dim").alias("dim"))
