"""Small file-system helpers through the session's own file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import SparkSession, functions as F


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system ``path`` names."""
    system, target = _at(spark, path)
    return system.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file's content."""
    system, target = _at(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place of another: written beside it, then renamed over it in one step."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        spark._jvm.org.apache.hadoop.fs.Path(path).toUri(), spark._jsc.hadoopConfiguration()
    )
    system, target = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4()}")
    stream = system.create(beside)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, overwrite)


def missing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files that are not there, by one listing of every folder."""
    folders: dict[str, set[str]] = {}
    for path in paths:
        folder = path.rpartition("/")[0]
        if folder not in folders:
            system, target = _at(spark, folder)
            folders[folder] = {s.getPath().getName() for s in system.listStatus(target)} if system.exists(target) else set()
    return [path for path in paths if path.rpartition("/")[2] not in folders[path.rpartition("/")[0]]]


def _tail(path: str) -> str:
    """The last three parts of a path, which tell the files of a feed apart."""
    return "/".join(unquote(path).split("/")[-3:])


def by_first_line(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """The text files grouped by their first line, read by one job over all of them."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = batch.select(["path", "line"]).filter(batch.column("start").cast(pa.int64()).to_numpy() == 0) if batch.num_rows else batch
            for path, line in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if path != last:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([line], pa.binary())], ["path", "line"])
                    last = path

    # A file's lines come in their order, and its first part holds the first of them.
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start")
    )
    shapes = lines.mapInArrow(first, "path string, line binary").groupBy("line").agg(F.collect_list("path").alias("paths")).collect()
    shape_of = {_tail(path): k for k, row in enumerate(shapes, 1) for path in row.paths}
    groups: dict[int, list[str]] = {}
    for path in paths:
        groups.setdefault(shape_of.get(_tail(path), 0), []).append(path)
    return list(groups.values())
