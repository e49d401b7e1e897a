"""Shared plumbing: table access, cut points in shared storage, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a text operator handles and hands on at once, however large the batches that it is given.
SLICE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only on one machine (tests) may the session name none; then a temporary folder is used and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        local = tempfile.mkdtemp(prefix="logloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def _cuts(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "cuts", spark.sparkContext.applicationId)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, tag: str, instead: DataFrame | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: lineage ends there and survives lost executors.

    ``instead`` is a cut that nothing needs any more once this one is written, such as the last round's; it is removed.
    """
    spark = df.sparkSession
    path = os.path.join(_cuts(spark), f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if instead is not None:
        uncut(instead)
    return out


def uncut(df: DataFrame) -> None:
    """Removes a cut that nothing needs any more, and lets Spark drop the shuffles of frames that are gone."""
    spark = df.sparkSession
    if getattr(df, "_cut_path", None):
        _remove(spark, df._cut_path)
        forget(spark)


def forget(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles of frames that are gone."""
    spark._jvm.System.gc()


def clear_cuts(spark: SparkSession) -> None:
    """Removes all tables that ``cut`` wrote in this application, for when the results of its queries have been taken."""
    _remove(spark, _cuts(spark))


def keep_columns(df: DataFrame, made: list[str]) -> list[str]:
    """Input columns that survive beside the made ones: a made column replaces an input column of its name (case-insensitive)."""
    names = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in names]


def row_keys(df: DataFrame, names: tuple[str, str] = ("_k1", "_k2")) -> list[Column]:
    """A key of 128 bits of each whole row. Whether a column is null counts, since hashes pass over nulls."""
    columns = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
    return [F.xxhash64(F.lit(n), *own).alias(name) for n, name, own in zip((1, 29), names, (columns, columns[::-1]), strict=True)]


def add_columns(df: DataFrame, text: str, made: T.StructType, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], also: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
    """``mapInArrow`` that appends the ``made`` columns to each row, and drops the columns ``without``.

    ``rows`` turns an iterator of batches (the text, then the columns ``also``) into lists of arrays, batch for batch.
    """
    kept = [c for c in keep_columns(df, made.fieldNames()) if c not in without]
    schema = T.StructType([df.schema[c] for c in kept] + list(made.fields))
    plain = isinstance(df.schema[text].dataType, T.StringType) or text in also
    fed = [(f"_in_{i}", F.col(f"`{c}`") if i or plain else F.col(f"`{c}`").cast("string")) for i, c in enumerate((text, *also))]
    place = [kept.index(c) if c in kept and (i or plain) else None for i, c in enumerate((text, *also))]
    extra = [x for x, p in zip(fed, place, strict=True) if p is None]
    at = iter(range(len(kept), len(kept) + len(extra)))
    place = [next(at) if p is None else p for p in place]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(name) for name, c in extra])
    fed_names = [name for name, _ in fed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in range(0, b.num_rows, SLICE):
                    part = b.slice(start, SLICE)
                    pending.append(part)
                    yield pa.RecordBatch.from_arrays([part.column(p) for p in place], names=fed_names)

        for made_arrays in rows(texts()):
            b = pending.pop(0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in range(len(kept))] + made_arrays, names=[*kept, *made.fieldNames()])
        release()

    return source.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``SLICE`` rows, each batch let go before the next one comes."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)
        del batch


def release() -> None:
    """Gives unused memory of a worker back to the system, so that workers that live on do not keep their largest size."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each string of an Arrow column as a view of its UTF-8 bytes; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield None if nulls is not None and nulls[i] else body[at[i] : at[i + 1]]
