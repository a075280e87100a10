"""Settings and small helpers that the text operators share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoloom.session import prepare, scratch_dir

TEXT_SETTINGS = {
    # Texts differ in length by thousands of times, so batches for Python are cut by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(6 << 20),
    # A shuffle of one step is deleted when the step has been written, not when the driver collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for key, value in TEXT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def place(spark: SparkSession) -> str:
    """A new folder in the shared place."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def numbered(df: DataFrame, columns: dict[str, Column], key: str) -> DataFrame:
    """The chosen columns and a number that tells rows apart, written once so that it never changes."""
    from geoloom.session import settle

    return settle(df.select(F.monotonically_increasing_id().alias(key), *[c.alias(n) for n, c in columns.items()]))


FILE = re.compile(r"part-(\d{1,6})-.*?(?:-c|\.c)(\d{1,3})\b.*")


def with_rows(docs: DataFrame, row: str, as_read: bool = False) -> DataFrame:
    """The rows with a number ``row`` that is the same in every later reading.

    With ``as_read`` the rows are those of a table that Spark has written, just as it was read, and the number is made of file and place in the file, so
    nothing is copied. In all other cases, other file names among them, the rows are written with their numbers.
    """
    from geoloom.session import settle

    if as_read and "_metadata" not in docs.columns:
        names = [FILE.fullmatch(os.path.basename(f)) for f in docs.inputFiles()]
        if names and all(names) and len({m.groups() for m in names}) == len(names):
            name = F.col("_metadata.file_name")
            number = F.regexp_extract(name, FILE.pattern, 1).cast("long") * 1000 + F.regexp_extract(name, FILE.pattern, 2).cast("long")
            try:
                return docs.select("*", (F.shiftleft(number, 33) + F.col("_metadata.row_index")).alias(row))
            except AnalysisException:  # not a table as read
                pass
    return settle(docs.select("*", F.monotonically_increasing_id().alias(row)))


def stay(docs: DataFrame, keep: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """Rows of ``docs`` whose number is in ``keep``, by one plan at every size."""
    return docs.join(keep.select(F.col("row").alias(row)).hint("shuffle_hash"), row, "left_semi").select(*[named(c) for c in columns])


class Memo(dict):
    """A table of results by word that is emptied when it is full; ``work`` fills it."""

    def __init__(self, work, most: int = 500_000, longest: int = 64):
        super().__init__()
        self.work, self.most, self.longest = work, most, longest

    def __missing__(self, word):
        out = self.work(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out
