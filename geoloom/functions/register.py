"""Optional SQL names. They are SQL functions, so the optimizer inlines them; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from geoloom.functions import tags as T

SCALARS = {
    "haversine_m(lat0 DOUBLE, lon0 DOUBLE, lat1 DOUBLE, lon1 DOUBLE)": (
        "DOUBLE", "12742017.6D * asin(least(1D, sqrt(pow(sin(radians(lat1 - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat1)) "
                  "* pow(sin(radians(lon1 - lon0) / 2), 2))))"),
    "mercator_x(lon DOUBLE)": ("DOUBLE", "radians(lon) * 6378137D"),
    "mercator_y(lat DOUBLE)": ("DOUBLE", "ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137D"),
    "project_x(lon DOUBLE, west DOUBLE, east DOUBLE, width DOUBLE)": ("DOUBLE", "((lon - west) / (east - west) - 0.5D) * width"),
    "project_y(lat DOUBLE, south DOUBLE, north DOUBLE, height DOUBLE)": (
        "DOUBLE", "((ln(tan(pi() / 4 + radians(lat) / 2)) - ln(tan(pi() / 4 + radians(south) / 2))) / (ln(tan(pi() / 4 + radians(north) / 2)) "
                  "- ln(tan(pi() / 4 + radians(south) / 2))) - 0.5D) * height"),
}


def _tag(key: str) -> str:
    return f"try_element_at(tags, '{key}')"


def _in(value: str, values: list[str]) -> str:
    return f"coalesce({value} IN ({', '.join(repr(v) for v in values)}), false)"


# Tag rules over a MAP<STRING, STRING>, from the value lists of the column functions.
_SPEED, _NUMBER = f"trim(lower(coalesce({_tag('maxspeed')}, '')))", r"^ *[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)(e[+-]?[0-9]+)? *$"
_FIGURE = f"regexp_replace({_SPEED}, '(mph|km/h)$', '')"
_NAME = f"coalesce(nullif({_tag('surface')}, ''), nullif({_tag('landuse')}, ''), nullif({_tag('natural')}, ''))"
_SAID = lambda key: f"coalesce({_tag(key)} NOT IN ('', 'no'), false)"
RULES = {
    "max_speed_kmh": ("DOUBLE", f"nullif(greatest(CASE WHEN {_FIGURE} RLIKE '{_NUMBER}' THEN try_cast(trim({_FIGURE}) AS DOUBLE) END "
                                f"* CASE WHEN {_SPEED} LIKE '%mph' THEN 1.609344D ELSE 1D END, 0D), 0D)"),
    "water_kind": ("STRING", f"CASE WHEN {_in(_tag('water'), ['pond', 'basin'])} OR {_tag('landuse')} <=> 'basin' OR {_in(_tag('waterway'), T.STREAMS + ['riverbank'])} "
                             f"OR {_in(_tag('water'), T.STREAMS)} THEN 'shallow' WHEN {_in(_tag('water'), ['lake', 'reservoir'])} OR {_tag('landuse')} <=> 'reservoir' THEN 'lake' "
                             f"WHEN {_tag('natural')} <=> 'water' THEN 'water-area' WHEN {_tag('natural')} <=> 'spring' OR {_tag('type')} <=> 'waterway' OR {_SAID('water')} "
                             f"OR {_SAID('waterway')} THEN 'metadata-only' END"),
    "surface_kind": ("STRING", f"CASE WHEN {_tag('landuse')} <=> 'forest' OR {_tag('natural')} <=> 'wood' THEN 'forest' WHEN {_in(_tag('natural'), ['scrub', 'heath'])} THEN 'shrubs' "
                               f"WHEN {_in(_NAME, T.PAVED)} THEN 'asphalt' WHEN {_in(_NAME, T.GRASSY)} THEN 'grass' WHEN {_in(_NAME, T.BARE)} THEN 'dirt' END"),
}
TILES = """CREATE OR REPLACE TEMPORARY FUNCTION covering_tiles(south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE, zoom INT) RETURNS TABLE (tx BIGINT, ty BIGINT)
RETURN SELECT tx, ty FROM (SELECT explode(sequence(greatest(0L, floor((radians(west) / (2 * pi()) + 0.5D) * pow(2, zoom))),
  least(CAST(pow(2, zoom) AS BIGINT) - 1, floor((radians(east) / (2 * pi()) + 0.5D) * pow(2, zoom))))) AS tx)
 CROSS JOIN (SELECT explode(sequence(greatest(0L, floor((0.5D - ln(tan(pi() / 4 + radians(north) / 2)) / (2 * pi())) * pow(2, zoom))),
  least(CAST(pow(2, zoom) AS BIGINT) - 1, floor((0.5D - ln(tan(pi() / 4 + radians(south) / 2)) / (2 * pi())) * pow(2, zoom))))) AS ty)"""


def register(spark: SparkSession) -> None:
    for signature, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    for name, (kind, body) in RULES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(tags MAP<STRING, STRING>) RETURNS {kind} RETURN {body}")
    spark.sql(TILES)
