"""Files that tasks open by themselves, on any file system that a URI names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def uri(path: str) -> str:
    """A path as listed by Spark, in the form that file system clients take."""
    path = re.sub(r"^file:/+", "file:///", path)
    return path if "://" in path else "file://" + path


def opened(path: str):
    """(file system, path on it) of a URI; runs in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri(path))


def read_part(path: str, start: int, size: int) -> bytes:
    system, name = opened(path)
    with system.open_input_file(name) as file:
        return file.read_at(size, start)


def write_whole(path: str, body: bytes) -> None:
    """Write a file under a name of its own and then give it its name, so a repeated task leaves one whole file."""
    import uuid

    system, name = opened(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as file:
        file.write(body)
    system.move(part, name)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files of a pattern, listed by Spark; no content is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")
