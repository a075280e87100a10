"""Map datasets on disk: tables, manifest, fingerprint, reports and height tiles."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType

from geoloom.operators.ordered import top_per_key
from geoloom.operators.raster import encode_heights
from geoloom.session import settle

REPORT = ("dataset STRING, input STRING, bounds ARRAY<DOUBLE>, mapSize ARRAY<DOUBLE>, settings MAP<STRING, STRING>, sourceSha256 STRING, "
          "luaSha256 STRING, alignment MAP<STRING, STRING>, output STRING, report STRING, edges BIGINT, sceneryItems BIGINT, "
          "placeLabels BIGINT, waterFeatures BIGINT, format STRING, converterDataset STRING")


def fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """24 hex digits that depend on the rows and their number, not on their order or partitioning.

    Names and types of the columns are hashed too. A row is hashed as its values in the order of their names, each with its length before it and
    null apart from every text; four numbers of the hash are added up over the rows, which combine in any order, and the totals are hashed.
    """
    by = by or []
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "".join(f"{len(c)}:{c}{len(kinds[c])}:{kinds[c]}" for c in sorted(kinds))
    framed = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    hashed = df.select(*by, F.sha2(F.concat(F.lit(schema), *[framed(F.col(c)) for c in sorted(df.columns)]), 256).alias("h"))
    word = lambda i: F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")
    sums = hashed.groupBy(*by).agg(*[F.sum(word(i)).alias(f"w{i}") for i in range(4)], F.count(F.lit(1)).alias("n"))
    whole = F.sha2(F.concat_ws("|", *[F.col(f"w{i}").cast("string") for i in range(4)], F.col("n").cast("string")), 256)
    return sums.select(*by, F.substring(whole, 1, 24).alias("fingerprint"), F.col("n").alias("rows"))


def same_dataset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two datasets but not as often in the other; empty when they are the same."""
    cols = a.columns
    left = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s")))
    return left.groupBy(*cols).agg(F.sum("_s").alias("difference")).where("difference <> 0")


def write_map_dataset(tables: dict[str, DataFrame], folder: str, manifest: dict) -> str:
    """Write the tables and, last of all, the manifest that makes them visible: returns the dataset id."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    counts, marks = {}, []
    for name, df in sorted(tables.items()):
        path = f"{folder}/data-{version}/{name}"
        df.write.parquet(path)
        stored = spark.read.schema(df.schema).parquet(path)
        mark = fingerprint(stored).first()
        counts[name] = mark["rows"]
        marks.append(f"{name}:{mark['fingerprint']}")
    dataset = spark.range(1).select(F.substring(F.sha2(F.lit(json.dumps([manifest, marks], sort_keys=True)), 256), 1, 24)).first()[0]
    body = json.dumps({**manifest, "dataset": dataset, "version": version, "counts": counts, "marks": marks}, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{folder}/manifest-{version}")
    _swap(spark, f"{folder}/manifest-{version}", f"{folder}/manifest")
    return dataset


def _swap(spark: SparkSession, new: str, name: str) -> None:
    """Give a finished folder its name. An older holder of the name is moved aside first and deleted after."""
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(name).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{new}-old"
    had = fs.exists(path(name))
    if had and not fs.rename(path(name), path(old)) or not fs.rename(path(new), path(name)):
        raise OSError(f"cannot give {new} the name {name}")
    if had:
        fs.delete(path(old), True)


def read_map_dataset(spark: SparkSession, folder: str, schemas: dict, verify: bool = True, expected: dict | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Tables and manifest of a dataset, the tables compared with the manifest's counts and marks unless ``verify`` is off.

    ``expected`` names what the caller built for, such as dataset, bounds, size or settings; a manifest that says otherwise is an error.
    """
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0], object_pairs_hook=_no_repeats)
    for name, value in (expected or {}).items():
        if manifest.get(name) != value:
            raise ValueError(f"the dataset's {name} is {manifest.get(name)!r}, not {value!r}")
    tables = {name: spark.read.schema(schemas[name]).parquet(f"{folder}/data-{manifest['version']}/{name}") for name in manifest["counts"]}
    if verify:
        for mark in manifest["marks"]:
            name, stored = mark.split(":")
            row = fingerprint(tables[name]).first()
            if row["fingerprint"] != stored or row["rows"] != manifest["counts"][name]:
                raise ValueError(f"table {name} differs from its manifest")
    return tables, manifest


def _no_repeats(pairs: list) -> dict:
    names = [name for name, _ in pairs]
    if len(set(names)) < len(names):
        raise ValueError(f"a JSON object names {next(n for n in names if names.count(n) > 1)!r} twice")
    return dict(pairs)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The sixteen alignment fields of a conversion report; everything else is parsed and dropped. Repeated names are an error."""
    @F.udf(BooleanType())
    def names_once(text: str) -> bool:
        json.loads(text, object_pairs_hook=_no_repeats)
        return True

    text = spark.read.text(path, wholetext=True).where(names_once("value"))
    out = text.select(F.from_json("value", REPORT, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    good = (F.coalesce("dataset", F.lit("")) != "") & (F.size("bounds") == 4) & (F.size("mapSize") == 2)
    return out.where(F.assert_true(good, F.lit("not a conversion report")).isNull())


def preview_slice(edges: DataFrame, nodes: DataFrame, scenery: DataFrame, labels: DataFrame, most: tuple[int, int, int]):
    """The first ``most`` edges with the nodes they use, first scenery and labels, and whether anything was left out."""
    e = edges.orderBy("edge_no").limit(most[0])
    used = e.select(F.explode(F.array("node0", "node1")).alias("node_id")).distinct()
    s, l = scenery.orderBy("item_id").limit(most[1]), labels.orderBy("label_id").limit(most[2])
    more = [df.limit(n + 1).agg((F.count(F.lit(1)) > n).alias("m")) for df, n in zip((edges, scenery, labels), most)]
    limited = more[0].unionByName(more[1]).unionByName(more[2]).agg(F.bool_or("m").alias("limited"))
    return e, nodes.join(used, "node_id", "left_semi"), s, l, limited


def head_with_omitted(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """First rows per key and how many were left out."""
    top = top_per_key(rows, by, order, most, "place")
    size = rows.groupBy(*by).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))
    return top.join(size, by)


def write_height_tiles(cells: DataFrame, folder: str, by: list[str], side: int = 128, manual: tuple[float, float] | None = None) -> None:
    """Heights, 16-bit codes and biomes (where ``cells`` has biome) as tiles under ``folder``/tiles, and what each grid's codes mean under ``folder``/ranges.

    The ranges hold lo, hi, the real lowest and highest height, cells and how many were clipped to a given range ``manual``.
    """
    rows = settle(encode_heights(cells, by, manual))
    ranges = rows.groupBy(*by, "lo", "hi").agg(F.min("z").alias("lowest"), F.max("z").alias("highest"), F.count(F.lit(1)).alias("cells"), F.count_if("clipped").alias("clipped"))
    tile = rows.drop("lo", "hi", "clipped").withColumns({"tr": F.floor(F.col("row") / side).cast("int"), "tc": F.floor(F.col("col") / side).cast("int")})
    keys = ["tr", "tc", *by]
    tile.repartition(*keys).sortWithinPartitions(*keys, "row", "col").write.partitionBy("tr", "tc").parquet(f"{folder}/tiles")
    ranges.write.parquet(f"{folder}/ranges")
