"""Point clouds: uncompressed LAS files, listed by Spark and read by ranges of records in its tasks."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.session import settle, spread
from geoloom.sources.files import listed, read_part, write_whole

SCHEMA = "x double, y double, z double, classification int, withheld boolean, file string"
CHUNK = 250_000
HEADER = ("file string, start long, form int, size int, count long, sx double, sy double, sz double, ox double, oy double, oz double, "
          "minx double, miny double, maxx double, maxy double")


def header(raw: bytes, path: str) -> dict:
    """The header fields that reading needs (LAS 1.0 to 1.4, formats 0 to 10)."""
    if raw[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    start, = struct.unpack_from("<I", raw, 96)
    form, length, count = struct.unpack_from("<BHI", raw, 104)
    if form & 0x80:
        raise ValueError(f"{path} is compressed; land it as Parquet first")
    if raw[25] >= 4 and count == 0:
        count, = struct.unpack_from("<Q", raw, 247)
    scale = struct.unpack_from("<6d", raw, 131)
    maxx, minx, maxy, miny = struct.unpack_from("<4d", raw, 179)
    return dict(file=path, start=start, form=form, size=length, count=count, minx=minx, miny=miny, maxx=maxx, maxy=maxy,
                **dict(zip(("sx", "sy", "sz", "ox", "oy", "oz"), scale)))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per LAS file of a path or pattern, read in tasks."""
    def read(batches):
        for batch in batches:
            rows = [header(read_part(name, 0, min(375, length)), name) for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            names = [c.split()[0] for c in HEADER.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[c.split()[1]]) for n, c in zip(names, HEADER.split(", "))], names)

    return spread(listed(spark, path), ["path"]).mapInArrow(read, HEADER)


def read_points(spark: SparkSession, path: str, max_points: int | None = None, chunk: int = CHUNK, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points of Parquet folders or LAS files: x, y, z, classification, withheld, file.

    With ``box`` (minx, miny, maxx, maxy) only points in it are returned, its borders included, and files whose header lies outside are not read.
    ``max_points`` leaves out files with more points, where a limit is wanted; ``headers`` tells which.
    """
    inside = F.lit(True) if box is None else F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    if not path.lower().endswith(".las"):
        return spark.read.schema(SCHEMA).parquet(path).where(inside)
    files = headers(spark, path).where("count > 0")
    if max_points is not None:
        files = files.where(F.col("count") <= max_points)
    if box is not None:
        files = files.where((F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1]))
    ranges = settle(files).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(chunk).cast("long"))))
    ranges = spread(ranges.withColumn("last", F.least(F.col("count"), F.col("first") + chunk)), ["file", "first"])

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                raw = np.frombuffer(read_part(r["file"], r["start"] + r["first"] * r["size"], (r["last"] - r["first"]) * r["size"]), "u1").reshape(-1, r["size"])
                xyz = raw[:, :12].copy().view("<i4").astype("float64")
                if r["form"] >= 6:
                    kind, held = raw[:, 16], (raw[:, 15] & 4) > 0
                else:
                    kind, held = raw[:, 15] & 31, (raw[:, 15] & 128) > 0
                yield pa.RecordBatch.from_pydict({
                    "x": xyz[:, 0] * r["sx"] + r["ox"], "y": xyz[:, 1] * r["sy"] + r["oy"], "z": xyz[:, 2] * r["sz"] + r["oz"],
                    "classification": kind.astype("int32"), "withheld": held, "file": [r["file"]] * len(raw)})

    return ranges.mapInArrow(decode, SCHEMA).where(inside)


def write_las(points: DataFrame, folder: str, scale: float = 0.01, most: int = 1_000_000) -> DataFrame:
    """Write x, y, z, classification and withheld as LAS 1.2 files of at most ``most`` points; returns file and n of each.

    Files are named by partition and place, so a repeated task writes the same files again.
    """
    def written(batches):
        from pyspark import TaskContext

        held, number, done = [], 0, []

        def flush():
            nonlocal held, number
            x, y, z, kind, withheld = (np.concatenate([h[i] for h in held]) for i in range(5))
            body = np.zeros(x.size, [("xyz", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("kind", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")])
            body["xyz"] = np.rint(np.stack([x, y, z], 1) / scale)
            body["kind"] = kind.astype(np.uint8) | np.where(withheld, 128, 0).astype(np.uint8)
            head = bytearray(227)
            head[:4], head[24], head[25] = b"LASF", 1, 2
            struct.pack_into("<HII", head, 94, 227, 227, 0)
            struct.pack_into("<BHI", head, 104, 0, 20, x.size)
            struct.pack_into("<6d", head, 131, scale, scale, scale, 0.0, 0.0, 0.0)
            struct.pack_into("<6d", head, 179, x.max(), x.min(), y.max(), y.min(), z.max(), z.min())
            name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{number:05d}.las"
            write_whole(name, bytes(head) + body.tobytes())
            done.append((name, x.size))
            held, number = [], number + 1

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            for at in range(0, batch.num_rows, most):
                held.append([c[at:at + most] for c in columns])
                if sum(h[0].size for h in held) >= most:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "n"])

    chosen = points.select(*[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("classification").cast("int").alias("classification"), F.coalesce("withheld", F.lit(False)).alias("withheld"))
    return settle(chosen.mapInArrow(written, "file string, n long"))
