"""Inventories, totals, dataset checks and expected-against-observed audits.

Audits compare counts per key rather than rows within a key, so duplicates of one edge or item, however
many, combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions import tags as T
from geoloom.functions.geo import dist, on_map
from geoloom.operators.graph import connected_groups


def count_entities(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    kind = lambda df, k: df.select(F.lit(k).alias("kind"))
    return kind(nodes, "nodes").unionByName(kind(ways, "ways")).unionByName(kind(relations, "relations")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"))


def feature_inventory(items: DataFrame) -> DataFrame:
    """Counts per category, per kind and per (category, kind) without unmatched items, in one pass.

    ``level`` names the grouping; items have category, kind and unmatched.
    """
    live = ~F.coalesce("unmatched", F.lit(False))
    sets = items.withColumn("live", live).groupingSets(
        [[F.col("category")], [F.col("kind")], [F.col("category"), F.col("kind")]], F.col("category"), F.col("kind"))
    rows = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("every"), F.count(F.when(F.col("live"), 1)).alias("live_n"))
    level = F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "kind").otherwise("bucket")
    out = rows.select(level.alias("level"), "category", "kind", F.when(F.col("g") == 0, F.col("live_n")).otherwise(F.col("every")).alias("n"))
    return out.where("(level <> 'kind' OR kind IS NOT NULL) AND n > 0")


def selected_totals(inventory: DataFrame, categories: dict, kinds: dict) -> DataFrame:
    """Scenery total of an option set, from the inventory buckets alone."""
    chosen = T.scenery_selected("category", "kind", F.lit(False), categories, kinds)
    return inventory.where("level = 'bucket'").where(chosen).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scenery"))


def dataset_summary(edges: DataFrame, items: DataFrame, labels: DataFrame, water: DataFrame) -> DataFrame:
    """One row per metric: metric, n."""
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "STREET").alias("road_segments"),
                  F.count_if(F.col("kind") == "TRACK").alias("rail_segments"), F.count_if("bridge").alias("bridge_segments"),
                  F.count_if("tunnel").alias("tunnel_segments"))
    i = items.agg(F.count(F.lit(1)).alias("scenery"))
    l = labels.agg(F.count(F.lit(1)).alias("labels"))
    w = water.agg(F.count(F.lit(1)).alias("water_features"), F.count_if(F.col("kind") == "lake").alias("lakes"))
    tall = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in df.columns])))
    return tall(e).unionByName(tall(i)).unionByName(tall(l)).unionByName(tall(w))


def node_degree(edges: DataFrame) -> DataFrame:
    """Degree of every node and its street and track parts, from node0, node1 and kind."""
    ends = edges.select(F.explode(F.array("node0", "node1")).alias("node"), "kind")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("kind") == "STREET").alias("streets"),
                                    F.count_if(F.col("kind") == "TRACK").alias("tracks"))


def reconcile_edges(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per unordered node pair: expected, observed, exact, reversed, wrong, missing and extra edges.

    Both sides have node0, node1, cls and kind. Exact twins pair first, then reversed twins, then
    whatever shares the pair; only counts are compared.
    """
    a, b = F.least("node0", "node1").alias("a"), F.greatest("node0", "node1").alias("b")
    count = lambda df, name: df.groupBy(a, b, "cls", "kind", (F.col("node0") <= F.col("node1")).alias("fwd")).agg(
        F.count(F.lit(1)).alias(name))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    keys = ["a", "b", "cls", "kind", "fwd"]
    rows = count(expected, "e").join(count(observed, "o"), keys, "full_outer").select(*keys, n("e").alias("e"), n("o").alias("o"))
    rows = rows.withColumn("exact", F.least("e", "o")).withColumns({"le": F.col("e") - F.col("exact"), "lo": F.col("o") - F.col("exact")})
    side = lambda c, fwd: F.sum(F.when(F.col("fwd") == fwd, F.col(c)).otherwise(0))
    same = rows.groupBy("a", "b", "cls", "kind").agg(
        F.sum("e").alias("e"), F.sum("o").alias("o"), F.sum("exact").alias("exact"), side("le", True).alias("fe"), side("le", False).alias("be"),
        side("lo", True).alias("fo"), side("lo", False).alias("bo"))
    turned = F.least("fe", "bo") + F.least("be", "fo")
    same = same.withColumn("reversed", turned).withColumns({"le": F.col("fe") + F.col("be") - F.col("reversed"),
                                                            "lo": F.col("fo") + F.col("bo") - F.col("reversed")})
    pair = same.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("e", "o", "exact", "reversed", "le", "lo")])
    wrong = F.least("le", "lo")
    return pair.select("a", "b", F.col("e").alias("expected"), F.col("o").alias("observed"), "exact", "reversed", wrong.alias("wrong"),
                       (F.col("le") - wrong).alias("missing"), (F.col("lo") - wrong).alias("extra"))


def reconcile_items(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Keys whose counts differ: key, expected, found, missing, extra."""
    e = expected.groupBy("key").agg(F.count(F.lit(1)).alias("expected"))
    f = found.groupBy("key").agg(F.count(F.lit(1)).alias("found"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = e.join(f, "key", "full_outer").select("key", n("expected").alias("expected"), n("found").alias("found"))
    return both.where("expected <> found").withColumns({
        "missing": F.greatest(F.col("expected") - F.col("found"), F.lit(0)), "extra": F.greatest(F.col("found") - F.col("expected"), F.lit(0))})


def reconcile_positions(expected: DataFrame, observed: DataFrame, tolerance: float = 0.01, turn: float = 1e-4) -> DataFrame:
    """Observed models without an expected one of the same name within a centimetre and the same angle.

    Both sides are first reduced to distinct placements, observed ones with counts. An expected placement goes to every bucket of eight
    centimetres that lies within the tolerance, mostly its own alone; an observed one looks into its own bucket.
    """
    cols = ["model", "x", "y", "rotation"]
    seen = observed.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    want = expected.select(*cols).distinct()
    side = 8 * tolerance
    cell = lambda c: F.floor(c / side).cast("long")
    span = lambda c: F.explode(F.sequence(cell(F.col(c) - 1.001 * tolerance), cell(F.col(c) + 1.001 * tolerance)))
    want = want.withColumn("_i", span("x")).withColumn("_j", span("y")).select(F.col("model").alias("wm"), F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("rotation").alias("wr"), "_i", "_j")
    two_pi = 2 * 3.141592653589793
    gap = F.abs(F.pmod(F.col("rotation") - F.col("wr") + two_pi / 2, F.lit(two_pi)) - two_pi / 2)
    hit = (F.abs(F.col("x") - F.col("wx")) <= tolerance) & (F.abs(F.col("y") - F.col("wy")) <= tolerance) & (gap <= turn)
    here = (F.col("model") == F.col("wm")) & (cell(F.col("x")) == F.col("_i")) & (cell(F.col("y")) == F.col("_j"))
    return seen.join(want, here & hit, "left_anti")


def import_progress(expected: DataFrame, counters: DataFrame) -> DataFrame:
    """Sections whose saved counter differs from the selection: section, expected, current."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return expected.join(counters, "section", "full_outer").select(
        "section", n("expected").alias("expected"), n("current").alias("current")).where("expected <> current")


def reconcile_towns(labels: DataFrame, records: DataFrame) -> DataFrame:
    """Town labels against town records, one to one: key, name, problem."""
    want = labels.select("label_id", F.col("name").alias("want"))
    have = records.select("label_id", F.col("name").alias("have"), "growth", "allowed", "complete")
    per = have.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.min("have").alias("have"), F.bool_and("complete").alias("complete"),
                                       F.bool_and(F.col("growth") == F.col("allowed")).alias("policy"))
    both = want.join(per, "label_id", "full_outer")
    problem = (F.when(F.col("n").isNull(), "missing town").when(F.col("want").isNull(), "unexpected town").when(F.col("n") > 1, "recorded twice")
               .when(F.col("want") != F.col("have"), "wrong name").when(~F.col("complete"), "incomplete").when(~F.col("policy"), "wrong growth policy"))
    return both.select("label_id", problem.alias("problem")).where("problem IS NOT NULL")


def retry_safety(failed: DataFrame, journal: DataFrame, items: DataFrame, built: DataFrame) -> DataFrame:
    """May a failed range of source items be replayed? dataset_id, safe, reason.

    ``failed`` has dataset_id, first, last; ``journal`` dataset_id, first, last, entity (one row per
    entity); ``items`` dataset_id, index, selected, ground (a face), collapses; ``built`` dataset_id, entity. Where ``failed`` has found_id, the
    dataset that was found to replay from must be that one, and where ``items`` has resolved, every selected item of the range must be.
    """
    f = failed.select("dataset_id", F.col("first").alias("lo"), F.col("last").alias("hi"))
    late = (f.join(journal.groupBy("dataset_id").agg(F.max("last").alias("top"), F.min(F.col("last") - F.col("first")).alias("span")), "dataset_id")
            .where("top >= lo OR span < 0").select("dataset_id", F.lit(1).alias("order"), F.lit("journal overlaps the range").alias("reason")))
    twice = (journal.groupBy("dataset_id", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dataset_id").distinct()
             .select("dataset_id", F.lit(2).alias("order"), F.lit("entity journalled twice").alias("reason")))
    part = (f.join(items, "dataset_id").where("index BETWEEN lo AND hi AND selected").groupBy("dataset_id")
            .agg(F.count_if(~F.col("ground")).alias("other"), F.count_if("collapses").alias("collapsed"), F.count(F.lit(1)).alias("n")))
    inside = f.join(part, "dataset_id", "left")
    mixed = inside.where("other > 0").select("dataset_id", F.lit(3).alias("order"), F.lit("range holds more than ground faces").alias("reason"))
    sound = inside.where("COALESCE(collapsed, 0) = 0").select("dataset_id", F.lit(4).alias("order"), F.lit("no collapsed face in range").alias("reason"))
    stray = (built.join(journal.select("dataset_id", "entity"), ["dataset_id", "entity"], "left_anti").select("dataset_id").distinct()
             .select("dataset_id", F.lit(5).alias("order"), F.lit("construction outside the journal").alias("reason")))
    other = failed.where(~F.col("dataset_id").eqNullSafe(F.col("found_id"))) if "found_id" in failed.columns else failed.limit(0)
    other = other.select("dataset_id", F.lit(0).alias("order"), F.lit("the original dataset is required").alias("reason"))
    lost = f.join(items, "dataset_id").where("index BETWEEN lo AND hi AND selected")
    lost = lost.where(~F.coalesce("resolved", F.lit(False))) if "resolved" in items.columns else lost.limit(0)
    lost = lost.select("dataset_id").distinct().select("dataset_id", F.lit(2).alias("order"), F.lit("a selected item cannot be resolved").alias("reason"))
    blocks = other.unionByName(lost).unionByName(late).unionByName(twice).unionByName(mixed).unionByName(sound).unionByName(stray)
    worst = blocks.groupBy("dataset_id").agg(F.min_by("reason", "order").alias("reason"))
    return failed.select("dataset_id").join(worst, "dataset_id", "left").select(
        "dataset_id", F.col("reason").isNull().alias("safe"), F.coalesce("reason", F.lit("safe to replay")).alias("reason"))


def check_map_dataset(edges: DataFrame, nodes: DataFrame, faces: DataFrame, labels: DataFrame, known: DataFrame,
                      width: float, height: float, target: tuple[float, float] | None = None) -> DataFrame:
    """Every broken rule of a dataset as rows: rule, entity. ``target`` is the size of the world it is meant for.

    faces: item_id, category, cls, corners, x, y (extreme corner); known: cls that exist; labels: label_id, name, town.
    """
    rule = lambda df, name, entity: df.select(F.lit(name).alias("rule"), F.col(entity).cast("string").alias("entity"))
    ends = edges.select("edge_id", F.explode(F.array("node0", "node1")).alias("node_id"))
    lost = ends.join(nodes.select("node_id"), "node_id", "left_anti").select("edge_id").distinct()
    at = lambda n, s: nodes.select(F.col("node_id").alias(n), F.col("x").alias("x" + s), F.col("y").alias("y" + s))
    placed = edges.join(at("node0", "0"), "node0").join(at("node1", "1"), "node1")
    same = placed.where((F.col("node0") == F.col("node1")) | (dist("x0", "y0", "x1", "y1") < 1e-8))
    off = nodes.where(~on_map("x", "y", width + 2e-5, height + 2e-5))
    unknown = faces.join(known, "cls", "left_anti")
    thin = faces.where("corners < 3")
    water = faces.where("category = 'waterways' AND corners <> 3")
    twins = labels.where("town").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = [rule(lost, "edge end does not exist", "edge_id"), rule(same, "edge ends coincide", "edge_id"), rule(off, "node off the map", "node_id"),
             rule(unknown, "unknown resource", "item_id"), rule(thin, "face with under three corners", "item_id"),
             rule(faces.where(~on_map("x", "y", width, height)), "face off the map", "item_id"),
             rule(water, "water face is no triangle", "item_id"), rule(twins, "town name used twice", "name")]
    if target is not None and (width > target[0] or height > target[1]):
        parts.append(nodes.sparkSession.range(1).select(F.lit("map does not fit its target").alias("rule"), F.lit(f"{width:g} x {height:g}").alias("entity")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Fields where a stored manifest and the data disagree: field, stored, actual."""
    both = manifest.join(actual, "field", "full_outer").select("field", F.col("stored"), F.col("actual"))
    return both.where("NOT (stored <=> actual)")


def audit_verdict(metrics: DataFrame, partial: bool = False) -> DataFrame:
    """One row: problems of all metrics, and the state problems, partial (something could not be looked at) or ok."""
    total = metrics.agg(F.coalesce(F.sum("problems"), F.lit(0)).alias("problems"))
    return total.withColumn("state", F.when(F.col("problems") > 0, "problems").when(F.lit(partial), "partial").otherwise("ok"))


def _counted(name: str, expected: DataFrame, found: DataFrame, problems: DataFrame) -> DataFrame:
    """A metric from the sizes of two tables and one row of problems."""
    size = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    rows = size(expected, "expected").join(size(found, "current"), F.lit(True)).join(problems, F.lit(True))
    return rows.select(F.lit(name).alias("metric"), "expected", "current", "problems")


def reconcile_import(expected_edges: DataFrame, observed_edges: DataFrame, expected_items: DataFrame, found_items: DataFrame,
                     expected_nodes: DataFrame, observed_nodes: DataFrame, tolerance: float = 0.01, labels: tuple[DataFrame, DataFrame] | None = None,
                     counters: tuple[DataFrame, DataFrame] | None = None, groups: bool = False) -> DataFrame:
    """The whole audit as metrics: metric, expected, current, problems.

    ``labels`` are the expected and the found names (key), ``counters`` the stored and the actual counts (field, stored or actual);
    with ``groups`` the connected parts of both networks are counted too. ``audit_verdict`` sums it up.
    """
    pairs = reconcile_edges(expected_edges, observed_edges).agg(
        F.sum("expected").alias("expected"), F.sum("observed").alias("current"),
        F.sum(F.col("reversed") + F.col("wrong") + F.col("missing") + F.col("extra")).alias("problems")).select(F.lit("edges").alias("metric"), "*")
    items = reconcile_items(expected_items, found_items).agg(F.coalesce(F.sum(F.col("missing") + F.col("extra")), F.lit(0)).alias("problems"))
    sized = expected_items.agg(F.count(F.lit(1)).alias("expected")).select("expected", F.lit(1).alias("_k")).join(
        found_items.agg(F.count(F.lit(1)).alias("current")).select("current", F.lit(1).alias("_k")), "_k").join(
        items.select("problems", F.lit(1).alias("_k")), "_k").select(F.lit("items").alias("metric"), "expected", "current", "problems")
    seen = observed_nodes.select("node_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    moved = ((F.abs(F.col("x") - F.col("ox")) > tolerance) | (F.abs(F.col("y") - F.col("oy")) > tolerance)
             | (F.abs(F.col("z") - F.col("oz")) > tolerance))
    bad = F.col("ox").isNull() | F.coalesce(moved, F.lit(False))
    nodes = expected_nodes.join(seen, "node_id", "left").agg(
        F.count(F.lit(1)).alias("expected"), F.count("ox").alias("current"), F.count_if(bad).alias("problems")).select(F.lit("nodes").alias("metric"), "*")
    degree = node_degree(expected_edges).select("node", F.col("degree").alias("want")).join(
        node_degree(observed_edges).select("node", F.col("degree").alias("have")), "node", "full_outer").agg(
        F.coalesce(F.sum("want"), F.lit(0)).alias("expected"), F.coalesce(F.sum("have"), F.lit(0)).alias("current"),
        F.count_if(~F.col("want").eqNullSafe(F.col("have"))).alias("problems")).select(F.lit("degrees").alias("metric"), "*")
    more = []
    if labels is not None:
        more.append(_counted("labels", *labels, reconcile_items(*labels).agg(F.coalesce(F.sum(F.col("missing") + F.col("extra")), F.lit(0)).alias("problems"))))
    if counters is not None:
        more.append(_counted("counters", *counters, check_manifest(*counters).agg(F.count(F.lit(1)).alias("problems"))))
    if groups:
        ends = lambda df: connected_groups(df.select(F.col("node0").alias("a"), F.col("node1").alias("b")))
        both = ends(expected_edges).select(F.col("groups").alias("expected")).join(ends(observed_edges).select(F.col("groups").alias("current")), F.lit(True))
        more.append(both.select(F.lit("groups").alias("metric"), "expected", "current", F.abs(F.col("expected") - F.col("current")).alias("problems")))
    out = pairs
    for part in (sized, nodes, degree, *more):
        out = out.unionByName(part)
    return out
