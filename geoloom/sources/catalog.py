"""Elevation catalogues: remote assets, local files, access rules and source metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.functions.geo import bbox_intersects, bbox_touches, finite
from geoloom.operators.ordered import block_row_number, first_rows, global_row_number, top_per_key
from geoloom.session import settle
from geoloom.spec import Bounds

FEATURE = ("STRUCT<collection: STRING, bbox: ARRAY<DOUBLE>, properties: STRUCT<datetime: STRING>, "
           "assets: MAP<STRING, STRUCT<href: STRING, `file:size`: BIGINT, roles: ARRAY<STRING>, type: STRING>>>")


def read_pages(pages: DataFrame, text: str, catalog: str) -> DataFrame:
    """Landed catalogue pages (JSON text with a list of features) as asset rows."""
    parsed = pages.select(F.col(catalog).alias("catalog_id"), F.from_json(F.col(text), f"features ARRAY<{FEATURE}>").alias("p"))
    feature = parsed.select("catalog_id", F.explode("p.features").alias("f"))
    asset = feature.select("catalog_id", "f.bbox", F.col("f.properties.datetime").alias("date"), F.explode(F.map_values("f.assets")).alias("a"))
    box = lambda i: F.get("bbox", F.lit(i))
    return asset.select("catalog_id", F.col("a.href").alias("url"), F.col("a.`file:size`").alias("bytes"), "date",
                        box(0).alias("minx"), box(1).alias("miny"), box(2).alias("maxx"), box(3).alias("maxy"))


def ingest_catalog(assets: DataFrame, box: tuple[float, float, float, float], most: int | None = None) -> DataFrame:
    """Usable assets of each catalogue: one row per URL, with a truncated flag and, under a cap, its place from the newest.

    With ``most`` only the newest of each catalogue stay; without, all do and rank is null.
    """
    usable = F.lower(F.regexp_extract("url", r"^https://[^/]+(/[^?#]*)", 1)).rlike(r"\.tiff?$")
    near = bbox_intersects(("minx", "miny", "maxx", "maxy"), [F.lit(float(v)) for v in box])
    per_url = assets.where(usable & near).groupBy("catalog_id", "url").agg(
        F.max(F.struct("date", "bytes", "minx", "miny", "maxx", "maxy")).alias("a"))
    rows = per_url.select("catalog_id", "url", "a.*")
    if most is None:
        return rows.withColumns({"rank": F.lit(None).cast("int"), "truncated": F.lit(False)})
    kept = top_per_key(rows, ["catalog_id"], [F.desc("date"), "url"], most, "rank")
    size = rows.groupBy("catalog_id").agg((F.count(F.lit(1)) > most).alias("truncated"))
    return kept.join(size, "catalog_id")


def catalog_access(assets: DataFrame, limit: int) -> DataFrame:
    """Per catalogue: tiles, blocked and a hint."""
    rows = assets.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("tiles"), F.bool_or("truncated").alias("truncated"))
    hint = (F.when(F.col("truncated"), "narrow the map").when(F.col("tiles") > limit, "raise the tile limit").otherwise("within the limit"))
    return rows.select("catalog_id", "tiles", ((F.col("tiles") > limit) | F.col("truncated")).alias("blocked"), hint.alias("hint"))


def newest_assets(assets: DataFrame) -> DataFrame:
    """Date order within each catalogue, newest first, then by url; dates that are none come last.

    A catalogue is numbered in blocks of a month, so one with a third of all assets is many tasks' work.
    """
    days = F.coalesce(-F.datediff(F.to_date("date"), F.lit("1970-01-01")), F.lit(1 << 30))
    numbered = block_row_number(assets.withColumn("_days", days), ["catalog_id"], ["_days", "url"], F.floor(F.col("_days") / 30), "place")
    return numbered.drop("_days")


def select_assets(assets: DataFrame, box: tuple[float, float, float, float], limit: int, most_bytes: int) -> DataFrame:
    """Assets of the chosen catalogues that meet the map, with the reason where one may not be fetched."""
    near = assets.where(bbox_intersects(("minx", "miny", "maxx", "maxy"), [F.lit(float(v)) for v in box]))
    size = assets.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("_n"))
    reason = (F.when(F.col("truncated"), "incomplete search").when(F.col("_n") > limit, "too many tiles")
              .when(F.coalesce("bytes", F.lit(0)) > most_bytes, "file too large"))
    return near.join(size, "catalog_id").withColumn("refused", reason).drop("_n")


# Regions that have a national height service, as west, south, east, north.
REGIONS = {"nordic": (10.0, 55.0, 25.0, 70.0), "america": (-180.0, 17.0, -65.0, 75.0)}


def route_requests(boxes: DataFrame, everything: bool) -> DataFrame:
    """Catalogues a box (minx..maxy) asks: the first region that fits, or all that do plus the worldwide one."""
    meets = {name: bbox_intersects(("minx", "miny", "maxx", "maxy"), [F.lit(v) for v in region]) for name, region in REGIONS.items()}
    if everything:
        names = F.array_compact(F.array(*[F.when(hit, name) for name, hit in meets.items()], F.lit("worldwide")))
    else:
        first = F.when(meets["nordic"], "nordic").when(meets["america"], "america").otherwise("worldwide")
        names = F.array(first)
    return boxes.withColumn("catalog", F.explode(names))


def normalise_extent(extents: DataFrame) -> DataFrame:
    """State of a header box: ok, unknown, or why it needs review. Nothing is guessed."""
    sound = finite("minx") & finite("miny") & finite("maxx") & finite("maxy")
    state = (F.when(F.col("minx").isNull(), "unknown").when(~sound, "invalid").when((F.col("minx") > F.col("maxx")) | (F.col("miny") > F.col("maxy")), "reversed")
             .when((F.col("minx") < -180) | (F.col("maxx") > 180) | (F.col("miny") < -90) | (F.col("maxy") > 90), "crosses the date line")
             .otherwise("ok"))
    return extents.withColumn("state", state)


def scan_extents(listing: DataFrame, cached: DataFrame, inspect) -> DataFrame:
    """Incremental extent catalogue: rows whose identity (path, size, mtime) is known are reused.

    ``inspect`` maps the new listing rows to their metadata; failures come back with a null kind, which is shown but is
    no cached row of a later scan, so that they are tried again. If the listing has the ``sidecars`` of ``with_sidecars``, they
    are part of the identity.
    """
    key = ["path", "size", "mtime", *(["sidecars"] if "sidecars" in listing.columns else [])]
    cached = cached.where("kind IS NOT NULL") if "kind" in cached.columns else cached
    fresh = inspect(listing.join(cached.select(*key), key, "left_anti"))
    kept = cached.join(listing.select(*key), key, "left_semi").withColumn("reused", F.lit(True))
    return kept.unionByName(fresh.withColumn("reused", F.lit(False)), allowMissingColumns=True)


# Files that hold heights, and endings of the files that describe one of them.
DATA_FILES, SIDECARS = ("tif", "tiff", "asc", "hgt", "las", "laz"), ("prj", "tfw", "tifw", "wld")


def with_sidecars(files: DataFrame) -> DataFrame:
    """Height files of a listing (path, size, mtime) with ``sidecars``: what stands beside each and describes it.

    A description has the file's name with another ending, or its whole name with .aux.xml added. Point files
    describe themselves.
    """
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    whole = F.regexp_replace("path", r"(?i)\.aux\.xml$", "")
    beside = files.withColumn("owner", F.when(ending.isin(*SIDECARS), stem).when(whole != F.col("path"), whole)).where("owner IS NOT NULL")
    beside = beside.select("owner", F.concat_ws(":", "path", "size", "mtime").alias("note"))
    data = files.where(ending.isin(*DATA_FILES)).withColumn("owner", F.explode(F.when(ending.isin("las", "laz"), F.array(F.lit(""))).otherwise(F.array(stem, F.col("path")))))
    return (data.join(beside, "owner", "left").groupBy("path", "size", "mtime")
            .agg(F.array_join(F.sort_array(F.collect_set("note")), "|").alias("sidecars")))  # at most five to a file


def overlapping_files(extents: DataFrame, bounds: Bounds) -> DataFrame:
    """Files that touch the map, and those of unknown place, which are never dropped for their name."""
    near = bbox_touches(("minx", "miny", "maxx", "maxy"), [F.lit(v) for v in (bounds.west, bounds.south, bounds.east, bounds.north)])
    known = F.col("state") == "ok"
    return extents.where(~known | near).withColumn("coverage", F.when(known, "overlap").otherwise("unknown"))


def rank_files(files: DataFrame, most: int | None = None) -> DataFrame:
    """The listed files with their place: overlaps before unknowns, by name and path. ``scan`` numbers their arrival.

    With ``most`` a full list takes a further overlap only in place of its oldest unknown, so overlaps stay in
    arrival order and unknowns are those of the first arrivals that were not pushed out.
    """
    if most is not None:
        overlap = settle(first_rows(files.where("coverage = 'overlap'"), ["scan"], most)[0])
        early = first_rows(files, ["scan"], most)[0].where("coverage = 'unknown'")
        room = most - overlap.count()
        files = overlap.unionByName(first_rows(early, [F.desc("scan")], room)[0])
    return global_row_number(files.withColumns({"_c": F.col("coverage") != "overlap", "_n": F.lower("name"), "_q": F.lower("path")}),
                             ["_c", "_n", "_q", "scan"], "place").drop("_c", "_n", "_q")


def classify_sources(sources: DataFrame) -> DataFrame:
    """Metadata gate of elevation files: accepted, needs review or rejected, with a reason."""
    colours = ["red", "green", "blue", "alpha", "palette"]
    reason = (F.when(F.lower("interp").isin(*colours), "image band").when(F.lower("dtype").startswith("complex"), "complex values")
              .when(F.col("crs").isNull() & F.col("crs_override").isNull(), "no coordinate system").when(~F.col("has_affine"), "no grid transform")
              .when(F.col("bands") != 1, "several bands"))
    state = (F.when(reason.isin("image band", "complex values", "no coordinate system"), "rejected").when(reason.isNotNull(), "needs review")
             .otherwise("accepted"))
    crs = F.coalesce("crs", "crs_override")
    return sources.select(
        "source", state.alias("state"), reason.alias("reason"), F.trim(F.split_part(crs, F.lit("+"), F.lit(1))).alias("horizontal"),
        F.coalesce("datum_tag", F.when(crs.contains("+"), F.trim(F.split_part(crs, F.lit("+"), F.lit(2)))), F.lit("Unknown / unchanged")).alias("datum"),
        F.lower(F.coalesce("synthetic", F.lit(""))).isin("true", "yes", "1").alias("synthetic"))


def source_priority(sources: DataFrame, finest_first: bool = True) -> DataFrame:
    """Number the sources of each map: finest first by their coarser axis, ties and the other mode in list order."""
    coarse = F.round(F.greatest("rx", "ry"), 6)
    block = F.floor(coarse) if finest_first else F.floor(F.col("file_pos") / 4096)
    return block_row_number(sources.withColumn("_coarse", coarse), ["map_id"], ["_coarse", "file_pos"] if finest_first else ["file_pos"], block, "priority").drop("_coarse")


def dedupe_paths(files: DataFrame, path: str, order: str) -> DataFrame:
    return files.groupBy(path).agg(F.min(order).alias(order))


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Each warning once, at its first occurrence."""
    return issues.groupBy("code", "entity").agg(F.min("seq").alias("seq"))
