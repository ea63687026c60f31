"""One query for each operator, over the views. ORACLE has the same in SQL, written on its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions import geometry as G
from waymesh.functions import scalars as S
from waymesh.functions import widths
from waymesh.operators import clicks, filters, graph, profile, styling, tiles, verbs
from waymesh.operators.styling import MISSING, STYLE_COLUMNS, CategoricalStyler, ClassStyler, ColorTableStyler, NumericStyler
from waymesh.plans import flow
from waymesh.plans.views import edges, view, view_sql
from waymesh.session import cut, shared_dir
from waymesh.sources import archive, blobs, files, ingest, palettes, shapefile, sinks
from waymesh.sources.settings import DEFAULT, MIN_ZOOM

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RAMP = ("#000000", "#ff8000", "#ffffff")
KINDS = {"click": "#ff0000", "VIEW": "#00ff00", "purchase": "#0000ff", "never": "#123456"}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (view_sql(*views) + " " if views else "") + sql
        return f

    return add


def _broken(df: DataFrame) -> DataFrame:
    """Some geometries null, some points."""
    point = F.struct(F.lit("Point").alias("gtype"), F.col("geometry.parts"))
    return df.withColumn("geometry", F.when(F.col("fid") % 10 == 3, F.lit(None)).when(F.col("fid") % 10 == 4, point).otherwise(F.col("geometry")))


def _r(c, n: int = 6):
    return F.round(c, n)


# -- SQL pieces -----------------------------------------------------------------------------------------------------

_KEY = "lower(trim(coalesce({c}, '')))"
_BASE = "regexp_replace(lower(trim(coalesce(highway, ''))), '_link$', '')"


def _ramp_sql(value: str, low: str, high: str, stops: tuple[str, ...] = RAMP, missing: str = "#cccccc") -> str:
    n = len(stops) - 1
    at = f"least(greatest(({value} - {low}) / CASE WHEN {high} = {low} THEN 1.0 ELSE {high} - {low} END, 0.0), 1.0) * {n}"
    seg = f"CAST(least(floor({at}), {n - 1}) AS INTEGER)"
    parts = []
    for i in (1, 3, 5):
        levels = "[" + ", ".join(str(int(s[i : i + 2], 16)) for s in stops) + "]"
        parts.append(f"CAST(floor({levels}[{seg} + 1] + ({levels}[{seg} + 2] - {levels}[{seg} + 1]) * ({at} - {seg}) + 0.5) AS INTEGER)")
    return f"CASE WHEN {value} IS NULL THEN '{missing}' ELSE printf('#%02x%02x%02x', {', '.join(parts)}) END"


def _palette_sql(name: str = "highsat") -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'"
    rows = ", ".join(f"('{k}', '{s.fill}', {s.width}, {s.casing_width}, {q(s.casing)}, {q(','.join(map(str, s.dash)) if s.dash else None)})" for k, s in palettes.PALETTES[name].items())
    return f"p(class, fill, width, cw, casing, dash) AS (VALUES {rows})"


def _style_sql(tunnel: str = "false", bridge: str = "false") -> str:
    """A row of the class style; e: the edge, c: its class."""
    scale = "CASE WHEN lower(trim(coalesce(highway, ''))) LIKE '%\\_link' ESCAPE '\\' THEN 0.7 ELSE 1.0 END"
    fade = f"CASE WHEN {tunnel} THEN 0.45 ELSE 1.0 END"
    cw = f"(p.cw * {scale})"
    return f"""SELECT e.fid, p.fill AS __rs_fill, round(CAST(p.width * {scale} AS DOUBLE), 6) AS __rs_w, round(CAST(0.9 * {fade} AS DOUBLE), 6) AS __rs_op, CASE WHEN {tunnel} THEN coalesce(p.dash, '4,4') ELSE p.dash END AS __rs_dash,
        CASE WHEN {bridge} THEN '#000000' ELSE p.casing END AS __rs_casing,
        round(CAST(CASE WHEN {bridge} THEN CASE WHEN {cw} = 0 THEN p.width * {scale} ELSE {cw} END + 1.5 ELSE {cw} END AS DOUBLE), 6) AS __rs_cw, round(CAST(0.75 * {fade} AS DOUBLE), 6) AS __rs_cop, {_BASE} AS __rs_class
        FROM v_edges e JOIN p ON p.class = CASE WHEN {_BASE} IN (SELECT class FROM p) THEN {_BASE} ELSE 'unclassified' END"""


def _styled(df: DataFrame, *more: str) -> DataFrame:
    numbers = {c: _r(F.col(c)) for c in ("__rs_w", "__rs_op", "__rs_cw", "__rs_cop")}
    return df.withColumns(numbers).select("fid", *STYLE_COLUMNS, *more)


# -- scalars and filters --------------------------------------------------------------------------------------------


@query(f"SELECT fid, {_BASE} AS base, lower(trim(coalesce(highway, ''))) LIKE '%\\_link' ESCAPE '\\' AS link FROM v_edges", ("edges",))
def normalize_class(spark, sf):
    return view(spark, sf, "edges").select("fid", S.base_class(F.col("highway")).alias("base"), S.is_link(F.col("highway")).alias("link"))


@query(f"SELECT fid FROM v_edges WHERE {_BASE} IN ('motorway', 'primary', 'secondary')", ("edges",))
def filter_include(spark, sf):
    return filters.filter_classes(view(spark, sf, "edges"), "highway", include=["Motorway", " primary", "secondary"]).select("fid")


@query(f"SELECT fid FROM v_edges WHERE {_BASE} NOT IN ('motorway', 'service')", ("edges",))
def filter_exclude(spark, sf):
    return filters.filter_classes(view(spark, sf, "edges"), "highway", exclude=["motorway", "service"]).select("fid")


@query("SELECT fid FROM v_edges WHERE lower(trim(coalesce(highway, ''))) IN ('motorway', 'secondary_link', '')", ("edges",))
def filter_exact_links(spark, sf):
    return filters.filter_classes(view(spark, sf, "edges"), "highway", include=["motorway", "secondary_link", ""], match_links=False).select("fid")


@query("SELECT fid, lower(coalesce(bridge, '')) IN ('yes', 'true', '1', 'y', 't') AS style, coalesce(bridge NOT IN ('', 'no', 'false', '0'), false) AS web, lower(coalesce(tunnel, '')) IN ('yes', 'true', '1') AS gpu FROM v_edges", ("edges",))
def truthy_variants(spark, sf):
    return view(spark, sf, "edges").select("fid", S.flag_for_style(F.col("bridge")).alias("style"), S.flag_for_web(F.col("bridge")).alias("web"), S.flag_for_gpu(F.col("tunnel")).alias("gpu"))


_LAYER = "CASE layer WHEN '3' THEN 3 WHEN '-2' THEN -2 WHEN '1.7' THEN 1 ELSE 0 END"
_LVL = f"CASE WHEN bridge IS NOT NULL AND bridge NOT IN ('', 'no', 'false', '0') THEN greatest(1, {_LAYER}) WHEN tunnel IS NOT NULL AND tunnel NOT IN ('', 'no', 'false', '0') THEN least(-1, {_LAYER}) ELSE least({_LAYER}, 0) END"


def _with_level(df: DataFrame) -> DataFrame:
    return df.withColumn("lvl", S.level(F.col("bridge"), F.col("tunnel"), F.col("layer")))


@query(f"SELECT fid, {_LVL} AS lvl FROM v_edges", ("edges",))
def grade_level(spark, sf):
    return _with_level(view(spark, sf, "edges")).select("fid", "lvl")


@query(f"SELECT fid FROM v_edges WHERE {_LVL} > 0", ("edges",))
def grade_bridges(spark, sf):
    return filters.on_grade(_with_level(view(spark, sf, "edges")), "bridge").select("fid")


_MINZ = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIN_ZOOM.items()) + " ELSE 0 END"


@query(f"SELECT fid FROM v_edges WHERE {_MINZ} <= 11", ("edges",))
def minzoom_visible(spark, sf):
    return filters.visible_at(view(spark, sf, "edges"), "highway", 11, MIN_ZOOM).select("fid")


@query("SELECT fid FROM v_edges WHERE highway IS NULL OR highway IN ('motorway', 'track')", ("edges",))
def classes_shown_keep_null(spark, sf):
    return filters.classes_shown(view(spark, sf, "edges"), "highway", ["motorway", "track"], keep_null=True).select("fid")


@query("SELECT fid, CASE WHEN layer IN ('3', '-2', '1.7') THEN CAST(layer AS DOUBLE) END AS number FROM v_edges", ("edges",))
def parse_numbers(spark, sf):
    df = view(spark, sf, "edges")
    return df.select("fid", S.as_number(F.col("layer"), df.schema["layer"].dataType).alias("number"))


@query("SELECT place, coalesce(nullif(trim(color), ''), '#bbbbbb') AS color FROM v_colors", ("colors",))
def literal_color(spark, sf):
    return view(spark, sf, "colors").select("place", S.color_or(F.col("color"), "#bbbbbb").alias("color"))


@query("SELECT fid, CASE WHEN fid % 2 = 0 THEN '\"' || (9007199254740992 + fid) || '\"' ELSE CAST(fid AS VARCHAR) END AS text FROM v_edges", ("edges",))
def exact_integers(spark, sf):
    big = F.when(F.col("fid") % 2 == 0, F.col("fid") + F.lit(9007199254740992)).otherwise(F.col("fid"))
    return view(spark, sf, "edges").select("fid", S.exact_text(big).alias("text"))


@query("SELECT fid, CASE WHEN v = floor(v) THEN format('{:,}', CAST(v AS BIGINT)) ELSE regexp_replace(regexp_replace(format('{:,.2f}', v), '0+$', ''), '\\.$', '') END AS tick FROM (SELECT fid, fid * 1000 + (fid % 4) * 0.25 AS v FROM v_edges)", ("edges",))
def legend_ticks(spark, sf):
    return view(spark, sf, "edges").select("fid", S.short_number((F.col("fid") * 1000 + (F.col("fid") % 4) * 0.25).cast("double")).alias("tick"))


# -- styles ---------------------------------------------------------------------------------------------------------


@query(", " + _palette_sql() + " " + _style_sql(), ("edges",))
def class_style(spark, sf):
    return _styled(styling.bake(view(spark, sf, "edges"), ClassStyler()))


@query(", " + _palette_sql("carto") + " " + _style_sql("lower(coalesce(tunnel, '')) IN ('yes', 'true', '1', 'y', 't')", "lower(coalesce(bridge, '')) IN ('yes', 'true', '1', 'y', 't')"), ("edges",))
def class_style_tunnel_bridge(spark, sf):
    return _styled(styling.bake(view(spark, sf, "edges"), ClassStyler(palette="carto", tunnel_col="tunnel", bridge_col="bridge")))


_KIND = "CASE lower(trim(coalesce(kind, ''))) WHEN 'click' THEN '#ff0000' WHEN 'view' THEN '#00ff00' WHEN 'purchase' THEN '#0000ff' END"


@query(f"SELECT fid, coalesce({_KIND}, '#cccccc') AS __rs_fill, coalesce(maybe, 0.0) AS __rs_w, lower(trim(coalesce(kind, ''))) AS __rs_class, {_KIND} IS NULL AS missing FROM v_dirty", ("dirty",))
def categorical_style(spark, sf):
    out = CategoricalStyler("kind", KINDS, width="maybe").apply(view(spark, sf, "dirty"))
    return out.select("fid", "__rs_fill", "__rs_w", "__rs_class", F.col(MISSING).alias("missing"))


@query("SELECT * FROM (VALUES (0, 'click', '#ff0000'), (1, 'VIEW', '#00ff00'), (2, 'purchase', '#0000ff'), (3, 'never', '#123456')) t(position, label, color) WHERE lower(label) IN (SELECT lower(trim(kind)) FROM v_dirty)", ("dirty",))
def legend_categories(spark, sf):
    return CategoricalStyler("kind", KINDS).present(view(spark, sf, "dirty"))


_COLORS = "c AS (SELECT CAST(id AS VARCHAR) AS id, arg_max(coalesce(color, '~'), place) AS color FROM v_colors GROUP BY id)"


@query(f", {_COLORS} SELECT fid, nullif(color, '~') AS color FROM v_edges LEFT JOIN c ON CAST(fid AS VARCHAR) = c.id", ("edges", "colors"))
def color_table_join(spark, sf):
    # max_by skips no nulls: the last row counts even if its colour is null.
    table = view(spark, sf, "colors")
    return styling.join_colors(view(spark, sf, "edges"), "fid", table, "id", "color", "place", into="color").select("fid", "color")


@query(
    f", {_COLORS}, {_palette_sql()}, s AS ({_style_sql()}) SELECT s.fid, coalesce(nullif(trim(nullif(color, '~')), ''), '#bbbbbb') AS __rs_fill, s.__rs_w, s.__rs_casing, s.__rs_class FROM s LEFT JOIN c ON CAST(s.fid AS VARCHAR) = c.id",
    ("edges", "colors"),
)
def color_table_style(spark, sf):
    joined = styling.join_colors(view(spark, sf, "edges"), "fid", view(spark, sf, "colors"), "id", "color", "place")
    return styling.bake(joined, ColorTableStyler("__color")).select("fid", "__rs_fill", _r("__rs_w").alias("__rs_w"), "__rs_casing", "__rs_class")


@query(f", r AS (SELECT min(maybe) AS lo, max(maybe) AS hi FROM v_dirty) SELECT fid, {_ramp_sql('maybe', 'lo', 'hi')} AS __rs_fill, maybe IS NULL AS missing FROM v_dirty, r", ("dirty",))
def numeric_ramp(spark, sf):
    out = NumericStyler("maybe", RAMP).apply(view(spark, sf, "dirty"))
    return out.select("fid", "__rs_fill", F.col(MISSING).alias("missing"))


@query(f"SELECT fid, {_ramp_sql('maybe', '20.0', '60.0', ('#102030', '#f0e0d0'))} AS __rs_fill FROM v_dirty", ("dirty",))
def numeric_ramp_fixed(spark, sf):
    return styling.bake(view(spark, sf, "dirty"), NumericStyler("maybe", ("#102030", "#f0e0d0"), 20, 60)).select("fid", "__rs_fill")


@query(", r AS (SELECT min(aadt) AS lo, max(aadt) AS hi FROM v_edges) SELECT fid, round(coalesce(1.0 + 7.0 * (aadt - lo) / (hi - lo), 1.0), 6) AS __rs_w FROM v_edges, r", ("edges",))
def width_ramp(spark, sf):
    return styling.bake(view(spark, sf, "edges"), NumericStyler("fid", width_by=(1, 8), width_column="aadt")).select("fid", _r("__rs_w").alias("__rs_w"))


def _options(missing: str):
    return {"Class": ClassStyler(palette="mono"), "Traffic": NumericStyler("aadt", RAMP, 0, 400000, missing=missing), "Direction": CategoricalStyler("oneway", {"yes": "#ff0000", "no": "#00ff00"}, missing=missing)}


def _options_sql(own: bool) -> str:
    traffic = _ramp_sql("aadt", "0.0", "400000.0")
    direction = "CASE oneway WHEN 'yes' THEN '#ff0000' WHEN 'no' THEN '#00ff00' ELSE '#cccccc' END"
    if not own:
        traffic, direction = f"CASE WHEN aadt IS NULL THEN __rs_fill ELSE {traffic} END", f"CASE WHEN oneway IS NULL THEN __rs_fill ELSE {direction} END"
    return f", {_palette_sql('mono')}, s AS ({_style_sql()}) SELECT s.fid, __rs_fill, {traffic} AS __rs_fill__1, {direction} AS __rs_fill__2, __rs_w FROM s JOIN v_edges e ON e.fid = s.fid"


@query(_options_sql(False), ("edges",))
def color_options_base(spark, sf):
    out, _ = styling.bake_options(view(spark, sf, "edges"), _options("base"))
    return out.select("fid", "__rs_fill", "__rs_fill__1", "__rs_fill__2", _r("__rs_w").alias("__rs_w"))


@query(_options_sql(True), ("edges",))
def color_options_self(spark, sf):
    out, _ = styling.bake_options(view(spark, sf, "edges"), _options("self"))
    return out.select("fid", "__rs_fill", "__rs_fill__1", "__rs_fill__2", _r("__rs_w").alias("__rs_w"))


@query(f", {_palette_sql()}, s AS ({_style_sql()}) SELECT fid, CAST('0x' || fill[2:3] AS INTEGER) AS r, CAST('0x' || fill[4:5] AS INTEGER) AS g, CAST('0x' || fill[6:7] AS INTEGER) AS b, 229 AS alpha FROM (SELECT fid, __rs_fill AS fill FROM s)", ("edges",))
def color_arrays(spark, sf):
    out = styling.to_arrays(styling.bake(view(spark, sf, "edges"), ClassStyler()))
    return out.select("fid", *[F.get("fill_rgba", F.lit(i)).alias(n) for i, n in enumerate(("r", "g", "b", "alpha"))])


# -- profiles -------------------------------------------------------------------------------------------------------


def _edges_of(spark, values):
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "bin int, upper double")


@query(", q AS (SELECT quantile_cont(aadt, [0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM v_edges) SELECT CAST(i AS INT) AS bin, round(q[i + 1], 6) AS upper FROM q, range(5) t(i)", ("edges",))
def classify_quantiles(spark, sf):
    return _edges_of(spark, profile.class_breaks(view(spark, sf, "edges"), "aadt", "quantiles", 5))


@query("SELECT i::INT AS bin, round(min(aadt) + (max(aadt) - min(aadt)) / 4 * (i + 1), 6) AS upper FROM v_edges, range(4) t(i) GROUP BY i", ("edges",))
def classify_equal(spark, sf):
    return _edges_of(spark, profile.class_breaks(view(spark, sf, "edges"), "aadt", "equal_interval", 4))


@query(
    ", m AS (SELECT avg(aadt) AS mu, stddev_pop(aadt) AS sd, max(aadt) AS hi FROM v_edges), u AS (SELECT mu + k * sd AS x FROM m, (VALUES (-2), (-1), (1), (2)) t(k) WHERE mu + k * sd < hi UNION SELECT hi FROM m) SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INT) AS bin, round(x, 6) AS upper FROM u",
    ("edges",),
)
def classify_std_mean(spark, sf):
    return _edges_of(spark, profile.class_breaks(view(spark, sf, "edges"), "aadt", "std_mean"))


@query()
def classify_natural(spark, sf):
    return _edges_of(spark, profile.class_breaks(view(spark, sf, "edges"), "aadt", "natural_breaks", 5))


@query("SELECT v AS value, CAST(floor(((row_number() OVER (ORDER BY v)) * 5 - 1) / (SELECT count(DISTINCT p_size) FROM part)) AS INT) AS grp FROM (SELECT DISTINCT p_size AS v FROM part)")
def equal_count_bins(spark, sf):
    return profile.even_groups(spark.read.parquet(f"{sf}/part.parquet"), "p_size")


@query("SELECT round(quantile_cont(aadt, 0.02), 6) AS vlow, round(quantile_cont(aadt, 0.98), 6) AS vhigh FROM v_edges", ("edges",))
def robust_range(spark, sf):
    return profile.robust_range(view(spark, sf, "edges"), "aadt").select(_r("vlow").alias("vlow"), _r("vhigh").alias("vhigh"))


@query("SELECT * FROM (VALUES ('p_partkey'), ('p_size'), ('p_retailprice')) t(name) UNION ALL SELECT 'p_brand' WHERE (SELECT count(DISTINCT p_brand) BETWEEN 1 AND 12 FROM part) UNION ALL SELECT 'p_type' WHERE (SELECT count(DISTINCT p_type) BETWEEN 1 AND 12 FROM part) UNION ALL SELECT 'p_name' WHERE (SELECT count(DISTINCT p_name) BETWEEN 1 AND 12 FROM part)")
def profile_columns(spark, sf):
    return spark.createDataFrame([(c,) for c in profile.eligible_columns(spark.read.parquet(f"{sf}/part.parquet"))], "name string")


@query("SELECT count(*) AS edges, count(DISTINCT nullif(highway, '')) AS classes, count(DISTINCT CASE WHEN trim(name) <> '' AND lower(name) <> 'nan' THEN name END) AS named, CAST(sum(fid % 100) AS DOUBLE) AS total_length FROM v_edges", ("edges",))
def report_kpis(spark, sf):
    return profile.kpis(view(spark, sf, "edges").withColumn("length_m", (F.col("fid") % 100).cast("double")), "highway")


@query("SELECT highway AS class, count(*) AS n FROM v_edges WHERE highway <> '' GROUP BY highway", ("edges",))
def class_counts(spark, sf):
    return profile.class_counts(view(spark, sf, "edges"), "highway")


@query("SELECT DISTINCT coalesce(highway, '') AS class FROM v_edges", ("edges",))
def class_list(spark, sf):
    return profile.class_list(view(spark, sf, "edges"), "highway")


def _case(column: str, table: dict, other) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


@query(f", {_palette_sql()}, s AS ({_style_sql()}) SELECT highway AS class, arg_min(__rs_fill, s.fid) AS swatch, CAST({_case("regexp_replace(highway, '_link$', '')", widths.Z_ORDER, 4)} AS DOUBLE) AS rank FROM s JOIN v_edges e ON e.fid = s.fid WHERE highway <> '' GROUP BY highway", ("edges",))
def class_first_fill(spark, sf):
    return profile.filter_panel(styling.bake(view(spark, sf, "edges"), ClassStyler()), "highway")


@query(f"SELECT bool_or({_LVL} > 0) AS bridges FROM v_edges", ("edges",))
def any_bridge(spark, sf):
    return profile.has_bridges(_with_level(view(spark, sf, "edges")))


_LISTED = ", ".join(f"'{k}'" for k in (*widths.GROUP, *widths.LINKS))
_RANK = f"{_LVL} * 1000.0 + CASE WHEN highway IN ({_LISTED}) THEN {_case("regexp_replace(highway, '_link$', '')", widths.Z_ORDER, 4)} - CASE WHEN highway LIKE '%\\_link' ESCAPE '\\' THEN 0.5 ELSE 0 END ELSE 4.0 END"


@query(f"SELECT fid, CAST({_RANK} AS DOUBLE) AS rank FROM v_edges", ("edges",))
def draw_order(spark, sf):
    df = _with_level(view(spark, sf, "edges")).withColumn("rank", widths.draw_rank(F.col("highway"), F.col("lvl")))
    return df.orderBy("rank", "fid").select("fid", "rank")


# -- verbs ----------------------------------------------------------------------------------------------------------


@query("SELECT min(fid) AS fid, name FROM v_edges WHERE name <> '' GROUP BY name ORDER BY fid LIMIT 30", ("edges",))
def first_per_name_30(spark, sf):
    return verbs.first_per_name(view(spark, sf, "edges"))


@query(
    "SELECT fid, CASE WHEN lower(highway) LIKE '%way%' OR lower(trim(coalesce(highway, ''))) NOT IN ('', 'nan', 'no', 'false', 'none', '0') THEN 'highway' ELSE 'oneway' END AS field, CASE WHEN lower(highway) LIKE '%way%' OR lower(trim(coalesce(highway, ''))) NOT IN ('', 'nan', 'no', 'false', 'none', '0') THEN highway ELSE oneway END AS value FROM v_edges WHERE lower(trim(coalesce(highway, ''))) NOT IN ('', 'nan', 'no', 'false', 'none', '0') OR lower(coalesce(oneway, '')) NOT IN ('', 'nan', 'no', 'false', 'none', '0')",
    ("edges",),
)
def search_hits_by_name(spark, sf):
    return verbs.search_hits(view(spark, sf, "edges"), "WAY", ["highway", "name", "oneway"])


@query("SELECT fid, 'name' AS field, name AS value FROM v_edges WHERE name LIKE '%road 1%' ORDER BY fid LIMIT 30", ("edges",))
def search_substring(spark, sf):
    return verbs.search(view(spark, sf, "edges"), "Road 1")


@query("SELECT fid FROM v_edges WHERE (aadt > 200000 AND NOT highway = 'service') OR name = 'road 5'", ("edges",))
def query_where(spark, sf):
    return verbs.query(view(spark, sf, "edges"), "(p.aadt > 200000 && !(p.highway == 'service')) || p.name === \"road 5\"")


@query("SELECT fid, highway, name, aadt FROM v_edges WHERE aadt > 300000", ("edges",))
def query_props(spark, sf):
    df = view(spark, sf, "edges").select("fid", "highway", "name", "aadt").withColumn("__rs_x", F.lit(1)).withColumn("lvl", F.lit(0))
    return verbs.properties(df, verbs.query(df, "aadt > 300000"))


@query("SELECT least(min(ax), min(zx)) / 1e6 AS minx, least(min(ay), min(zy)) / 1e6 AS miny, greatest(max(ax), max(zx)) / 1e6 AS maxx, greatest(max(ay), max(zy)) / 1e6 AS maxy FROM v_edges WHERE highway = 'trunk'", ("edges",))
def query_extent(spark, sf):
    df = edges(spark, sf)
    return verbs.focus(df, verbs.query(df, "highway = 'trunk'"))


@query(f", {_palette_sql()}, s AS ({_style_sql()}) SELECT s.fid, CASE WHEN aadt > 250000 THEN '#ff00ff' ELSE __rs_fill END AS __rs_fill FROM s JOIN v_edges e ON e.fid = s.fid", ("edges",))
def recolor_ids(spark, sf):
    df = view(spark, sf, "edges")
    return verbs.recolor(styling.bake(df, ClassStyler()), verbs.query(df, "aadt > 250000"), "#ff00ff").select("fid", "__rs_fill")


@query("SELECT fid, name = 'road 7' AND name IS NOT NULL AS highlighted FROM v_edges", ("edges",))
def highlight_ids(spark, sf):
    df = view(spark, sf, "edges")
    return verbs.highlight(df, verbs.query(df, "name = 'road 7'")).select("fid", "highlighted")


@query("SELECT fid FROM v_edges WHERE name = 'road 7' AND highway IN ('trunk', 'track')", ("edges",))
def ids_and_classes(spark, sf):
    df = view(spark, sf, "edges")
    return verbs.keep_ids(filters.classes_shown(df, "highway", ["trunk", "track"], keep_null=False), verbs.query(df, "name = 'road 7'")).select("fid")


@query("SELECT k AS area_id, fid FROM v_edges, range(0, 6) t(k) WHERE ax / 1e6 > 17.9 + k * 0.05 + 0.0000005 AND ax / 1e6 < 17.9 + k * 0.05 + 0.0800005 AND ay / 1e6 > 59.2000005 AND ay / 1e6 < 59.3000005", ("edges",))
def hit_test(spark, sf):
    x0, x1, y0, y1 = F.lit(17.9000005) + F.col("id") * 0.05, F.lit(17.9800005) + F.col("id") * 0.05, F.lit(59.2000005), F.lit(59.3000005)
    areas = spark.range(6).select(F.col("id").alias("area_id"), G.line((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)).alias("ring"))
    points = view(spark, sf, "edges").select("fid", (F.col("ax") / 1e6).alias("x"), (F.col("ay") / 1e6).alias("y"))
    return verbs.hit_test(areas, points, cell=0.05).select("area_id", "fid")


# Clicks beside the streets, two for each of their edges, some off their reach.
_CLICKS = "clicks AS (SELECT fid AS click_id, mx + (fid % 5 - 2) * 60 AS cx, my + (fid % 7 - 3) * 60 AS cy FROM v_streets)"
_NEAREST = f""", {_CLICKS}, seg AS (SELECT fid, ax / 1e6 AS px, ay / 1e6 AS py, mx / 1e6 AS qx, my / 1e6 AS qy FROM v_streets UNION ALL SELECT fid, mx / 1e6, my / 1e6, zx / 1e6, zy / 1e6 FROM v_streets),
    cell AS (SELECT *, unnest(range(CAST(floor((least(px, qx) - 0.0005) / 0.01) AS BIGINT), CAST(floor((greatest(px, qx) + 0.0005) / 0.01) AS BIGINT) + 1)) AS gx FROM seg),
    grid AS (SELECT *, unnest(range(CAST(floor((least(py, qy) - 0.0005) / 0.01) AS BIGINT), CAST(floor((greatest(py, qy) + 0.0005) / 0.01) AS BIGINT) + 1)) AS gy FROM cell),
    pin AS (SELECT click_id, cx / 1e6 AS x, cy / 1e6 AS y, CAST(floor(cx / 1e6 / 0.01) AS BIGINT) AS gx, CAST(floor(cy / 1e6 / 0.01) AS BIGINT) AS gy FROM clicks),
    flat AS (SELECT click_id, fid, (px - x) * cos(radians(y)) * 111320.0 AS x0, (py - y) * 111320.0 AS y0, (qx - x) * cos(radians(y)) * 111320.0 AS x1, (qy - y) * 111320.0 AS y1 FROM pin JOIN grid USING (gx, gy)),
    foot AS (SELECT *, least(greatest(-(x0 * (x1 - x0) + y0 * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 0.0), 1.0) AS t FROM flat),
    dist AS (SELECT click_id, fid, sqrt(pow(x0 + t * (x1 - x0), 2) + pow(y0 + t * (y1 - y0), 2)) AS d FROM foot),
    road AS (SELECT click_id, arg_min(fid, (round(d, 6), fid)) AS fid, min(round(d, 6)) AS metres FROM dist WHERE d <= 10.0 GROUP BY click_id)"""


def _clicks(spark, sf):
    df = edges(spark, sf, "streets")
    at = df.select(F.col("fid").alias("click_id"), ((F.col("mx") + (F.col("fid") % 5 - 2) * 60) / 1e6).alias("x"), ((F.col("my") + (F.col("fid") % 7 - 3) * 60) / 1e6).alias("y"))
    return df.select("fid", "vertices"), at


@query(_NEAREST + " SELECT click_id, metres FROM road", ("streets",))
def nearest_road(spark, sf):
    # The way back of a street lies on it, so which of the two is nearer hangs on the last bit: only the distance is compared.
    roads, at = _clicks(spark, sf)
    return clicks.nearest_line(at, roads).select("click_id", _r("metres").alias("metres"))


# Blocks under every third street and stops over every seventh click.
_OVERLAYS = """, block AS (SELECT DISTINCT k, (17000000 + (k % 800) * 9000 + 1000.5) / 1e6 AS x0, (17000000 + (k % 800) * 9000 + 4000.5) / 1e6 AS x1, (58000000 + (k // 800) * 5000 - 500.5) / 1e6 AS y0, (58000000 + (k // 800) * 5000 + 900.5) / 1e6 AS y1 FROM v_streets WHERE k % 3 = 0),
    inside AS (SELECT click_id, min(k) AS fid FROM pin JOIN block ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY click_id)"""


@query(
    _NEAREST + _OVERLAYS + """, best AS (SELECT click_id, CASE WHEN click_id % 7 = 0 THEN 'over' WHEN road.fid IS NOT NULL THEN 'road' ELSE 'under' END AS hit, inside.fid AS block FROM pin LEFT JOIN road USING (click_id) LEFT JOIN inside USING (click_id)
        WHERE click_id % 7 = 0 OR road.fid IS NOT NULL OR inside.fid IS NOT NULL)
    SELECT click_id, hit, CASE hit WHEN 'over' THEN 'stops' WHEN 'road' THEN 'roads' ELSE 'blocks' END AS layer, CASE WHEN hit = 'road' AND block IS NOT NULL THEN 'blocks:' || block ELSE '' END AS others FROM best""",
    ("streets",),
)
def click_precedence(spark, sf):
    roads, at = _clicks(spark, sf)
    k = view(spark, sf, "streets").select("k").distinct().filter("k % 3 = 0")
    x, y = 17000000 + (F.col("k") % 800) * 9000, 58000000 + F.floor(F.col("k") / 800) * 5000
    x0, x1, y0, y1 = (x + 1000.5) / 1e6, (x + 4000.5) / 1e6, (y - 500.5) / 1e6, (y + 900.5) / 1e6
    shape = lambda kind, v: F.struct(F.lit(kind).alias("gtype"), F.array(v).alias("parts")).alias("geometry")
    blocks = k.select(F.col("k").alias("fid"), shape("Polygon", G.line((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))
    stops = at.filter("click_id % 7 = 0").select(F.col("click_id").alias("fid"), shape("Point", G.line((F.col("x"), F.col("y")))))
    # A stop a click of its own, one metre wide: clicks lie further apart than that.
    found = clicks.click(at, roads, [clicks.ClickLayer("blocks", blocks, under=True), clicks.ClickLayer("stops", stops, reach_m=1.0)])
    others = F.array_join(F.transform("overlays", lambda o: F.concat(o["layer"], F.lit(":"), o["fid"].cast("string"))), ",")
    return found.select("click_id", "hit", "layer", others.alias("others"))


@query(f", {_palette_sql("carto")}, s AS ({_style_sql()}) SELECT DISTINCT __rs_dash AS dash FROM s WHERE __rs_dash IS NOT NULL", ("edges",))
def dash_values(spark, sf):
    return profile.dash_values(styling.bake(view(spark, sf, "edges"), ClassStyler(palette="carto")))


@query("SELECT count(*) AS rows, count(*) FILTER (fid % 10 = 3) AS unusable, count(*) FILTER (fid % 10 = 4) AS non_lines FROM v_edges", ("edges",))
def drop_counts(spark, sf):
    return filters.drop_counts(_broken(edges(spark, sf)))


@query("SELECT 'LineString,Point' AS types, false AS all_null")
def geometry_types(spark, sf):
    return profile.geometry_types(_broken(edges(spark, sf))).withColumn("types", F.array_join("types", ","))


@query("SELECT fid, CAST(sum(fid % 100) OVER (PARTITION BY name ORDER BY fid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM v_chain", ("chain",))
def running_length(spark, sf):
    return profile.running_total(view(spark, sf, "chain").withColumn("v", F.col("fid") % 100), "name", "fid", "v").select("fid", "running")


@query(_options_sql(False).replace("SELECT s.fid, __rs_fill,", "SELECT fid, __rs_fill__2 AS fill FROM (SELECT s.fid, __rs_fill,", 1) + ") AS x", ("edges",))
def color_field(spark, sf):
    out, meta = styling.bake_options(view(spark, sf, "edges"), _options("base"))
    return out.select("fid", verbs.color_field(out, [m["name"] for m in meta], "Direction").alias("fill"))


@query("SELECT fid, round(156543.03392 * cos(radians(ay / 1e6)) / pow(2, 18), 9) AS metres FROM v_edges", ("edges",))
def metres_per_pixel(spark, sf):
    return view(spark, sf, "edges").select("fid", _r(G.metres_per_pixel(F.col("ay") / 1e6, 18), 9).alias("metres"))


@query(f", {_palette_sql()}, s AS ({_style_sql()}) SELECT fid, round(__rs_w * 3.0, 6) AS halo, round(__rs_w * 1.8, 6) AS ring, round(__rs_w * 1.5, 6) AS core FROM s", ("edges",))
def selection_widths(spark, sf):
    df = styling.bake(view(spark, sf, "edges"), ClassStyler())
    return df.select("fid", *[_r(c).alias(k) for k, c in styling.selection_style(F.col("__rs_w")).items()])


# -- network --------------------------------------------------------------------------------------------------------

_TWOWAY = ", t AS (SELECT z AS ra, a AS rz, count(*) AS n FROM v_edges GROUP BY z, a), w AS (SELECT e.*, CASE WHEN e.a = e.z THEN coalesce(n, 0) >= 2 ELSE coalesce(n, 0) >= 1 END AS twoway FROM v_edges e LEFT JOIN t ON e.a = t.ra AND e.z = t.rz)"


@query(_TWOWAY + " SELECT fid, twoway FROM w", ("edges",))
def twoway(spark, sf):
    return graph.mark_twoway(view(spark, sf, "edges")).select("fid", "twoway")


@query(_TWOWAY + " SELECT fid, CASE WHEN oneway IS NOT NULL THEN oneway NOT IN ('', 'no', 'false', '0') ELSE NOT twoway END AS arrow FROM w", ("edges",))
def oneway_arrows(spark, sf):
    return graph.mark_twoway(view(spark, sf, "edges")).select("fid", F.col("__rs_oneway").alias("arrow"))


@query("SELECT node, count(*) AS degree FROM (SELECT a AS node FROM v_edges UNION ALL SELECT z FROM v_edges) GROUP BY node", ("edges",))
def node_degree(spark, sf):
    return graph.node_degree(view(spark, sf, "edges"))


@query("SELECT e.fid, min(f.fid) AS twin FROM v_edges e JOIN v_edges f ON least(e.a, e.z) = least(f.a, f.z) AND greatest(e.a, e.z) = greatest(f.a, f.z) AND e.fid <> f.fid GROUP BY e.fid", ("edges",))
def twin_of(spark, sf):
    return graph.twins(view(spark, sf, "edges"))


@query(", g AS (SELECT oneway, highway, count(*) AS n, min(fid) AS first FROM v_edges GROUP BY oneway, highway) SELECT oneway, arg_max(coalesce(highway, '~'), n * 1000000000 - first) AS mode FROM g GROUP BY oneway", ("edges",))
def group_mode_class(spark, sf):
    return graph.group_mode(view(spark, sf, "edges"), ["oneway"], "highway").select("oneway", F.coalesce("mode", F.lit("~")).alias("mode"))


@query(", n AS (SELECT fid, a AS node FROM v_chain UNION ALL SELECT fid, z FROM v_chain) SELECT node, min(fid) AS lo, max(fid) AS hi FROM n GROUP BY node HAVING count(*) = 2 AND min(fid) <> max(fid)", ("chain",))
def continuation_edges(spark, sf):
    return graph.continuations(view(spark, sf, "chain"))


_WALK = """, n AS (SELECT fid, name, a AS node FROM v_chain UNION ALL SELECT fid, name, z FROM v_chain),
    k AS (SELECT min(fid) AS lo, max(fid) AS hi FROM n GROUP BY name, node HAVING count(*) = 2 AND min(fid) <> max(fid)),
    pair AS (SELECT lo AS x, hi AS y FROM k UNION ALL SELECT hi, lo FROM k)"""


@query(view_sql("chain").replace("WITH ", "WITH RECURSIVE ", 1) + _WALK + ", walk(fid, r) AS (SELECT fid, fid FROM v_chain UNION SELECT b.y, w.r FROM walk w JOIN pair b ON w.fid = b.x) SELECT fid, min(r) AS chain FROM walk GROUP BY fid")
def chain_components(spark, sf):
    return graph.chains(view(spark, sf, "chain"), ["name"]).select("fid", "chain")


_HALF = """, n AS (SELECT fid, name, ow, a AS node FROM v_chain UNION ALL SELECT fid, name, ow, z FROM v_chain),
    k AS (SELECT name, ow, node, min(fid) AS lo, max(fid) AS hi FROM n GROUP BY name, ow, node HAVING count(*) = 2 AND min(fid) <> max(fid)),
    half AS (SELECT 2 * fid AS h, fid, z AS head, name, ow FROM v_chain UNION ALL SELECT 2 * fid + 1, fid, a, name, ow FROM v_chain WHERE NOT ow),
    succ AS (SELECT half.h, CASE WHEN o.a = half.head THEN 2 * o.fid ELSE 2 * o.fid + 1 END AS nxt
        FROM half JOIN k ON half.name IS NOT DISTINCT FROM k.name AND half.ow = k.ow AND half.head = k.node JOIN v_chain o ON o.fid = k.lo + k.hi - half.fid WHERE o.a = half.head OR NOT half.ow),
    walk(h, root, pos) AS (SELECT h, h, 0 FROM half WHERE h NOT IN (SELECT nxt FROM succ) UNION ALL SELECT s.nxt, w.root, w.pos + 1 FROM walk w JOIN succ s ON s.h = w.h),
    low AS (SELECT root, min(h) AS least FROM walk GROUP BY root)
    SELECT h // 2 AS fid, least // 2 AS chain, CAST(pos AS BIGINT) AS pos, h % 2 = 0 AS forward FROM walk JOIN low USING (root) WHERE least % 2 = 0"""


@query(view_sql("chain").replace("WITH ", "WITH RECURSIVE ", 1) + _HALF)
def chain_order(spark, sf):
    return graph.chains(view(spark, sf, "chain"), ["name", "ow"], F.col("ow"))


def _network(spark, sf):
    return graph.mark_twoway(_with_level(graph.edge_nodes(edges(spark, sf, "streets"))))


# Streets are cut where bridges begin and end; the way back of an edge is not drawn again. Segments in metres from a chain's
# first vertex, then slots of 100 m as sums over the segments that they overlap.
_SLOTS = """, e AS (SELECT fid, k, j, name, highway, ax, ay, mx, my, zx, zy, CASE WHEN bridge = 'yes' THEN 1 ELSE 0 END AS lvl, CASE WHEN bridge = 'yes' THEN 1 WHEN k % 2 = 0 AND j > 4 THEN 2 ELSE 0 END AS part,
        CASE WHEN oneway IS NOT NULL THEN oneway = 'yes' ELSE k % 5 < 2 END AS ow FROM v_streets WHERE twice = 0),
    c AS (SELECT *, min(fid) OVER (PARTITION BY k, part) AS chain FROM e),
    votes AS (SELECT name, lvl, ow, highway, count(*) AS n, min(fid) AS first FROM c GROUP BY ALL),
    mode AS (SELECT name, lvl, ow, arg_max(highway, n * 1000000000 - first) AS class FROM votes GROUP BY ALL),
    about AS (SELECT c.chain, c.name, c.ow, mode.class, ax / 1e6 AS lon0, ay / 1e6 AS lat0 FROM c JOIN mode ON c.name IS NOT DISTINCT FROM mode.name AND c.lvl = mode.lvl AND c.ow = mode.ow WHERE fid = chain),
    seg AS (SELECT chain, j * 2 AS i, ax AS x0, ay AS y0, mx AS x1, my AS y1 FROM c UNION ALL SELECT chain, j * 2 + 1, mx, my, zx, zy FROM c),
    loc AS (SELECT chain, i, lon0, lat0, (x0 / 1e6 - lon0) * cos(radians(lat0)) * 111320.0 AS x0, (y0 / 1e6 - lat0) * 111320.0 AS y0, (x1 / 1e6 - lon0) * cos(radians(lat0)) * 111320.0 AS x1, (y1 / 1e6 - lat0) * 111320.0 AS y1 FROM seg JOIN about USING (chain)),
    len AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS d FROM loc),
    run AS (SELECT *, sum(d) OVER (PARTITION BY chain ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop, sum(d) OVER (PARTITION BY chain) AS total FROM len),
    sized AS (SELECT *, stop - d AS start, greatest(1, CAST(floor(total / 100.0) AS INT) + CASE WHEN total - floor(total / 100.0) * 100.0 > 30.0 THEN 1 ELSE 0 END) AS n FROM run),
    cut AS (SELECT *, unnest(range(n)) AS slot FROM sized),
    piece AS (SELECT *, greatest(start, slot * 100.0) AS a, least(stop, (slot + 1) * 100.0, total) AS b FROM cut WHERE start < (slot + 1) * 100.0 AND stop > slot * 100.0),
    slots AS (SELECT chain, slot, sum(b - a) AS metres, count(*) + 1 AS n_vertices, arg_min(x0 + (x1 - x0) * (a - start) / d, i) AS x, arg_min(y0 + (y1 - y0) * (a - start) / d, i) AS y FROM piece GROUP BY chain, slot)
    SELECT chain, CAST(slot AS INT) AS slot, name, class, CAST(ow AS INT) AS oneway, CAST(n_vertices AS INT) AS n_vertices, round(x / (cos(radians(lat0)) * 111320.0) + lon0, 6) AS x, round(y / 111320.0 + lat0, 6) AS y
    FROM slots JOIN about USING (chain) WHERE metres >= 20.0"""


@query(_SLOTS, ("streets",))
def annotation_slots(spark, sf):
    first = F.get("vertices", F.lit(0))
    return graph.annotation_slots(_network(spark, sf)).select("chain", "slot", "name", "class", "oneway", F.size("vertices").alias("n_vertices"), first["x"].alias("x"), first["y"].alias("y"))


def _decks_sql() -> str:
    """Bridges of the streets: slices every 2.5 m on the 40 m at either end and between edges on the level part; then the
    ribbon of each side and the two rims, each by its first corner."""
    d = DEFAULT.decks
    width = _case("class", {c: widths.width_at(widths.GROUP[c], d["match_zoom"]) for c in ("residential", "primary", "tertiary", "motorway")}, 0)
    ramp, step = d["ramp_m"], d["step_m"]
    return f""", e AS (SELECT fid, k, j, highway AS class, k % 5 >= 2 AS two, ax, ay, mx, my, zx, zy, min(fid) OVER (PARTITION BY k) AS chain FROM v_streets WHERE twice = 0 AND bridge = 'yes'),
        about AS (SELECT chain, ax / 1e6 AS lon0, ay / 1e6 AS lat0, cos(radians(ay / 1e6)) * 111320.0 AS kx, {G.PIXEL_M} * cos(radians(ay / 1e6)) / pow(2, {d['match_zoom']}) AS pixel FROM e WHERE fid = chain),
        seg AS (SELECT chain, fid, two, class, j * 2 AS i, ax AS x0, ay AS y0, mx AS x1, my AS y1 FROM e UNION ALL SELECT chain, fid, two, class, j * 2 + 1, mx, my, zx, zy FROM e),
        loc AS (SELECT chain, fid, two, class, i, (x0 / 1e6 - lon0) * kx AS x0, (y0 / 1e6 - lat0) * 111320.0 AS y0, (x1 / 1e6 - lon0) * kx AS x1, (y1 / 1e6 - lat0) * 111320.0 AS y1 FROM seg JOIN about USING (chain)),
        len AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS d FROM loc),
        run AS (SELECT *, sum(d) OVER (PARTITION BY chain ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop, sum(d) OVER (PARTITION BY chain) AS total FROM len),
        ends AS (SELECT chain, fid, any_value(total) AS total, max(stop) AS e FROM run GROUP BY chain, fid),
        cuts AS (SELECT DISTINCT chain, v FROM (
            SELECT chain, unnest([0.0, total, {ramp}, total - {ramp}]) AS v FROM ends UNION ALL SELECT chain, unnest(range(1, {int(ramp / step)})) * {step} FROM ends
            UNION ALL SELECT chain, total - unnest(range(1, {int(ramp / step)})) * {step} FROM ends UNION ALL SELECT chain, e FROM ends WHERE e > {ramp} AND e < total - {ramp})),
        slices AS (SELECT chain, v AS a, lead(v) OVER (PARTITION BY chain ORDER BY v) AS b FROM cuts),
        placed AS (SELECT s.chain, a, b, r.fid, r.two, r.class, least((a + b) / 2 / {ramp}, (total - (a + b) / 2) / {ramp}, 1.0) AS u FROM slices s JOIN run r ON r.chain = s.chain AND (a + b) / 2 > r.stop - r.d AND (a + b) / 2 <= r.stop WHERE b - a > 1e-9),
        corner AS (SELECT p.*, r.x0 + (r.x1 - r.x0) * (a - (r.stop - r.d)) / r.d AS px, r.y0 + (r.y1 - r.y0) * (a - (r.stop - r.d)) / r.d AS py, -(r.y1 - r.y0) / r.d AS nx, (r.x1 - r.x0) / r.d AS ny
            FROM placed p JOIN run r ON r.chain = p.chain AND a + 1e-6 > r.stop - r.d AND a + 1e-6 <= r.stop),
        bends AS (SELECT p.chain, a, count(r.stop) AS n FROM placed p LEFT JOIN run r ON r.chain = p.chain AND r.stop > a + 1e-6 AND r.stop < b - 1e-6 GROUP BY p.chain, a),
        sized AS (SELECT f.*, n, {d['base_m']} * u * u * (3 - 2 * u) AS base, greatest({width} * pixel / 2, 2.0) * {d['width_scale']} AS half, {d['casing_px']} * pixel AS rim, kx, lon0, lat0 FROM corner f JOIN bends USING (chain, a) JOIN about USING (chain)),
        parts AS (
            SELECT *, CASE WHEN two AND side > 0 THEN fid + 1 ELSE fid END AS owner, 'deck' AS kind, base AS low, base + {d['thickness_m']} AS high, CASE WHEN two THEN side * half / 2 + half / 2 ELSE half END AS shift FROM sized, (VALUES (-1.0), (1.0)) t(side) WHERE two OR side > 0
            UNION ALL SELECT *, fid, 'casing', greatest(base - 0.5, 0.0), base + {d['thickness_m']} * 0.35, side * (half + rim / 2) + rim / 2 FROM sized, (VALUES (-1.0), (1.0)) t(side))
        SELECT chain, owner AS fid, kind, round(low, 2) AS base, round(high, 2) AS height, CAST(2 * (n + 2) + 1 AS INT) AS n_vertices, round((px + nx * shift) / kx + lon0, 6) AS x, round((py + ny * shift) / 111320.0 + lat0, 6) AS y FROM parts"""


@query(_decks_sql(), ("streets",))
def bridge_decks(spark, sf):
    return graph.bridge_decks(_network(spark, sf)).select("chain", "fid", "kind", "base", "height", F.size("vertices").alias("n_vertices"), F.get("vertices", F.lit(0))["x"].alias("x"), F.get("vertices", F.lit(0))["y"].alias("y"))


@query("SELECT fid, greatest(1, CAST(floor(v / 100.0) AS INT) + CASE WHEN v - floor(v / 100.0) * 100.0 > 30.0 THEN 1 ELSE 0 END) AS slots FROM (SELECT fid, fid % 1000 + 0.5 AS v FROM v_edges)", ("edges",))
def slot_count(spark, sf):
    return view(spark, sf, "edges").select("fid", graph.slot_count((F.col("fid") % 1000 + 0.5).cast("double"), 100.0).alias("slots"))


# -- widths, geometry, tiles ----------------------------------------------------------------------------------------


def _width_sql() -> str:
    stops = ", ".join(f"('{g}', {z}, {w}.0e0)" if isinstance(w, int) else f"('{g}', {z}, {w}e0)" for g, s in widths.WIDTH.items() for z, w in s.items())
    rates = _case("g", widths.RATE, 0)
    group = _case("regexp_replace(highway, '_link$', '')", {k: f"'{v}'" for k, v in widths.GROUP.items()}, "'residential'")
    return f""", stop(g, z, w) AS (VALUES {stops}), zoom AS (SELECT unnest([12, 13, 14, 15, 16, 17, 18, 19, 20]) AS zoom),
        cls AS (SELECT DISTINCT highway, {group} AS g, CASE WHEN highway IN ({', '.join(f"'{x}'" for x in widths.LINKS)}) THEN 0.6 ELSE 1.0 END AS s FROM v_edges WHERE highway IN ({_LISTED})),
        gw AS (SELECT highway, zoom, s, CASE WHEN zoom <= (SELECT min(z) FROM stop WHERE stop.g = cls.g) THEN (SELECT arg_min(w, z) FROM stop WHERE stop.g = cls.g)
            WHEN zoom >= (SELECT max(z) FROM stop WHERE stop.g = cls.g) THEN (SELECT arg_max(w, z) FROM stop WHERE stop.g = cls.g) * pow({rates}, zoom - (SELECT max(z) FROM stop WHERE stop.g = cls.g))
            ELSE (SELECT arg_max(w, z) FROM stop WHERE stop.g = cls.g AND z <= zoom) + ((SELECT arg_min(w, z) FROM stop WHERE stop.g = cls.g AND z > zoom) - (SELECT arg_max(w, z) FROM stop WHERE stop.g = cls.g AND z <= zoom))
                * (zoom - (SELECT max(z) FROM stop WHERE stop.g = cls.g AND z <= zoom)) / ((SELECT min(z) FROM stop WHERE stop.g = cls.g AND z > zoom) - (SELECT max(z) FROM stop WHERE stop.g = cls.g AND z <= zoom)) END AS w FROM cls, zoom)"""


@query(_width_sql() + " SELECT highway AS class, zoom, CAST(round(w * s * 1000) AS BIGINT) AS milli FROM gw", ("edges",))
def zoom_width(spark, sf):
    # In thousandths of a pixel, before rounding to hundredths, so that ties can't fall either way.
    have = view(spark, sf, "edges").filter(F.col("highway").isin(*widths.GROUP, *widths.LINKS)).select(F.col("highway").alias("class")).distinct()
    rows = [(n, z, round(widths.width_at(widths.GROUP.get(n.removesuffix("_link"), widths.OTHER), z) * (widths.LINK_SCALE if n.endswith("_link") else 1) * 1000)) for n in (*widths.GROUP, *widths.LINKS) for z in widths.ZOOMS]
    return have.join(F.broadcast(spark.createDataFrame(rows, "class string, zoom int, milli bigint")), "class")


@query(_TWOWAY + ", z AS (SELECT unnest([14, 15, 16, 17, 18]) AS zoom) SELECT fid, zoom, CASE WHEN twoway THEN round(10.0 * 0.28 * least(greatest((zoom - 15) / 2.0, 0), 1), 3) ELSE 0.0 END AS shift, CASE WHEN twoway THEN 10.0 * (1 - 0.4 * least(greatest((zoom - 15) / 2.0, 0), 1)) ELSE 10.0 END AS width FROM w, z", ("edges",))
def lane_offset(spark, sf):
    df = graph.mark_twoway(view(spark, sf, "edges")).withColumn("zoom", F.explode(F.sequence(F.lit(14), F.lit(18))))
    return df.select("fid", "zoom", widths.lane_offset(F.lit(10.0), F.col("twoway"), F.col("zoom")).alias("shift"), widths.lane_width(F.lit(10.0), F.col("twoway"), F.col("zoom")).alias("width"))


_MX, _MY = "{c} / 1e6 * 20037508.342789244 / 180.0", "ln(tan((90 + {c} / 1e6) * pi() / 360.0)) * 20037508.342789244 / pi()"


@query(f"SELECT fid, round({_MX.format(c='ax')}, 4) AS x, round({_MY.format(c='ay')}, 4) AS y FROM v_edges", ("edges",))
def mercator(spark, sf):
    return view(spark, sf, "edges").select("fid", _r(G.mercator_x(F.col("ax") / 1e6), 4).alias("x"), _r(G.mercator_y(F.col("ay") / 1e6), 4).alias("y"))


_BOX = f"box AS (SELECT fid, highway, least({_MX.format(c='ax')}, {_MX.format(c='zx')}) AS x0, greatest({_MX.format(c='ax')}, {_MX.format(c='zx')}) AS x1, least({_MY.format(c='ay')}, {_MY.format(c='zy')}) AS y0, greatest({_MY.format(c='ay')}, {_MY.format(c='zy')}) AS y1 FROM v_edges)"
_IDX = "CAST(least(greatest(floor({v} / (2 * 20037508.342789244 / pow(2, {z}))), 0), pow(2, {z}) - 1) AS BIGINT)"


def _cover_sql(z: str) -> str:
    x = lambda v: _IDX.format(v=f"({v} + 20037508.342789244)", z=z)
    y = lambda v: _IDX.format(v=f"(20037508.342789244 - {v})", z=z)
    return f"unnest(range({x('x0')}, {x('x1')} + 1)) AS x, {y('y1')} AS ya, {y('y0')} AS yb"


@query(f", {_BOX}, c AS (SELECT fid, {_cover_sql('10')} FROM box) SELECT fid, x, unnest(range(ya, yb + 1)) AS y FROM c", ("edges",))
def tile_cover(spark, sf):
    boxes = edges(spark, sf).withColumn("box", G.bounds(G.to_mercator(F.col("vertices"))))
    return tiles.tile_cover(boxes, F.lit(10)).select("fid", "x", "y")


_STREET_BOX = "box AS (SELECT fid, highway, " + ", ".join(f"{f}({', '.join(m.format(c=p + c) for p in 'amz')}) AS {c}{i}" for c, m in (("x", _MX), ("y", _MY)) for i, f in enumerate(("least", "greatest"))) + " FROM v_streets)"


@query(f", {_STREET_BOX}, zs AS (SELECT unnest(range(6, 16)) AS z), c AS (SELECT fid, z, {_cover_sql('z')} FROM box, zs WHERE {_MINZ} <= z), t AS (SELECT z, x, unnest(range(ya, yb + 1)) AS y FROM c) SELECT CAST(z AS INT) AS z, x, y, 'roads' AS layer, count(*) AS features FROM t GROUP BY z, x, y", ("streets",))
def tile_feature_counts(spark, sf):
    return tiles.tile_counts(tiles.tile_rows(edges(spark, sf, "streets"), "highway", ["highway"], MIN_ZOOM, DEFAULT.tiles, whole=True))


# As above, without the lines that become one pixel of their tile: there is nothing to draw.
_PIXEL = {"x": "round_even((p{p}x - (x * s - 20037508.342789244)) / s * 4096, 0)", "y": "round_even((20037508.342789244 - y * s - p{p}y) / s * 4096, 0)"}
_AT = ", ".join(f"{m.format(c=p + c)} AS p{p}{c}" for c, m in (("x", _MX), ("y", _MY)) for p in "amz")


@query(
    f""", {_STREET_BOX}, pos AS (SELECT fid, {_AT} FROM v_streets), zs AS (SELECT unnest(range(6, 16)) AS z), c AS (SELECT fid, z, {_cover_sql('z')} FROM box, zs WHERE {_MINZ} <= z),
        t AS (SELECT fid, z, 2 * 20037508.342789244 / pow(2, z) AS s, x, unnest(range(ya, yb + 1)) AS y FROM c)
        SELECT CAST(z AS INT) AS z, x, y, 'roads' AS layer, count(*) AS features FROM t JOIN pos USING (fid)
        WHERE NOT ({" AND ".join(f"{_PIXEL[c].format(p='a')} = {_PIXEL[c].format(p=p)}" for c in "xy" for p in "mz")}) GROUP BY z, x, y""",
    ("streets",),
)
def tiles_archive(spark, sf):
    """All tiles of the streets in one archive, counted again as the archive is read."""
    df = edges(spark, sf, "streets").select("fid", "highway", "vertices")
    built = tiles.build_tiles([tiles.tile_rows(df, "highway", ["highway"], MIN_ZOOM, DEFAULT.tiles, whole=True)])
    return archive.round_trip(built, lambda read: tiles.tile_summary(read).drop("extent"))


@query()
def tiles_encoded(spark, sf):
    df = styling.bake(edges(spark, sf, "streets"), ClassStyler())
    rows = tiles.packed_rows(df, "highway", ["highway"], MIN_ZOOM, DEFAULT.tiles)
    return tiles.build_tiles([rows]).select("z", "x", "y", F.length("tile").alias("n_bytes"))


@query("SELECT fid, zx / 1e6 AS mid_x, zy / 1e6 AS mid_y, least(ax, zx) / 1e6 AS minx, least(ay, zy) / 1e6 AS miny, greatest(ax, zx) / 1e6 AS maxx, greatest(ay, zy) / 1e6 AS maxy FROM v_edges", ("edges",))
def sidecar_bbox(spark, sf):
    side = tiles.sidecar(edges(spark, sf).select("fid", "highway", "geometry"))
    return side.select("fid", F.col("mid.x").alias("mid_x"), F.col("mid.y").alias("mid_y"), "bbox.minx", "bbox.miny", "bbox.maxx", "bbox.maxy")


@query("SELECT fid, round(sqrt(pow((zx - ax) / 1e6 * 111320.0 * cos(radians(ay / 1e6)), 2) + pow((zy - ay) / 1e6 * 111320.0, 2)), 3) AS metres FROM v_edges", ("edges",))
def metric_length(spark, sf):
    first = F.get("vertices", F.lit(0))
    df = edges(spark, sf).withColumns({"lon0": first["x"], "lat0": first["y"]})
    return df.select("fid", _r(G.length(G.local_metres(F.col("vertices"), F.col("lon0"), F.col("lat0"))), 3).alias("metres"))


@query("SELECT fid, round(ax / 1e6 + (zx - ax) / 1e6 * 0.25, 9) AS x, round(ay / 1e6 + (zy - ay) / 1e6 * 0.25, 9) AS y FROM v_edges", ("edges",))
def line_quarter_point(spark, sf):
    total = G.length(F.col("vertices"))
    part = G.substring(F.col("vertices"), total * 0.25, total * 0.5)
    df = edges(spark, sf).withColumn("p", F.get(part, F.lit(0)))
    return df.select("fid", _r("p.x", 9).alias("x"), _r("p.y", 9).alias("y"))


@query("SELECT fid, ax, ay, zx, zy FROM v_edges WHERE fid % 10 NOT IN (3, 4)", ("edges",))
def ingest_normalise(spark, sf):
    table = ingest.normalise(_broken(edges(spark, sf)).drop("vertices")).df
    end = lambda p, f: G.node_key(p[f])
    a, z = F.get("vertices", F.lit(0)), F.element_at("vertices", -1)
    return table.select("fid", end(a, "x").alias("ax"), end(a, "y").alias("ay"), end(z, "x").alias("zx"), end(z, "y").alias("zy"))


@query("SELECT fid, highway, name, k, fid * 0.25e0 AS quarter, ax, ay, mx, my, zx, zy FROM v_streets WHERE fid % 10 <> 3", ("streets",))
def ingest_shapefile(spark, sf):
    """The streets as shapefiles, every tenth row with a null shape, read back by ranges of records."""
    folder = f"{shared_dir(spark)}/shapes-{uuid.uuid4().hex}"
    df = edges(spark, sf, "streets").select("fid", "highway", "name", "k", (F.col("fid") * F.lit(0.25)).alias("quarter"), F.when(F.col("fid") % 10 != 3, F.col("geometry")).alias("geometry"))
    shapefile.write_shapefiles(df, folder)
    table = cut(shapefile.read_shapefile(spark, folder).df)
    files.remove(folder)
    corner = lambda i, f: G.node_key(F.get("vertices", F.lit(i))[f])
    return table.select("fid", "highway", "name", "k", "quarter", *[corner(i, f).alias(p + f) for i, p in enumerate("amz") for f in "xy"])


def _corners(df, names="az", also=()):
    """The ends of each line (and what lies between) as millionths of a degree."""
    corner = lambda i, f: G.node_key(F.element_at("vertices", i)[f])
    return df.select("fid", *also, *[corner(i, f).alias(p + f) for i, p in zip((1, 2, -1) if len(names) == 3 else (1, -1), names) for f in "xy"])


@query("SELECT fid, ax, ay, mx, my, zx, zy FROM v_streets WHERE fid % 10 <> 7", ("streets",))
def ingest_wkt(spark, sf):
    """Well-known text in several spellings, some of it broken."""
    pair = lambda p: F.concat_ws(" ", *[F.format_string("%.6f", F.col(p + c) / 1e6) for c in "xy"])
    inner = F.concat_ws(", ", *map(pair, "amz"))
    text = F.when(F.col("fid") % 10 == 7, "LINESTRING (1").when(F.col("fid") % 10 == 8, F.concat(F.lit("multilinestring(("), inner, F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING ("), inner, F.lit(")")))
    table = view(spark, sf, "streets").select("fid", "highway", text.alias("wkt"))
    return _corners(ingest.normalise(table).df, "amz")


@query("SELECT fid, highway, name, ax, ay, mx, my, zx, zy FROM v_streets", ("streets",))
def ingest_geojson_lines(spark, sf):
    """The streets as GeoJSON lines, read back."""
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    df = edges(spark, sf, "streets").select("fid", "highway", "name", "geometry")
    sinks.write_geojson_lines(df, folder)
    table = cut(ingest.read_geojson(spark, folder, lines=True, properties="fid long, highway string, name string").df)
    files.remove(folder)
    return _corners(table, "amz", ("highway", "name"))


@query("SELECT fid, ax, ay, zx, zy FROM v_edges", ("edges",))
def reproject_mercator(spark, sf):
    df = edges(spark, sf).select("fid", "highway", G.to_mercator(F.col("vertices")).alias("geometry"))
    return _corners(ingest.normalise(df, srid=3857).df)


@query("SELECT fid, highway, aadt FROM v_edges", ("edges",))
def tooltip_fields(spark, sf):
    return filters.tooltip_columns(edges(spark, sf), ["fid", "highway", "no_such_column", "aadt"])


@query("SELECT fid, highway, name FROM v_edges WHERE name = 'road 7'", ("edges",))
def popup_fields(spark, sf):
    df = edges(spark, sf).select("fid", "highway", "name", "geometry").withColumns({"__rs_fill": F.lit("#000000"), "lvl": F.lit(0), "twoway": F.lit(True)})
    return filters.popup_columns(df.filter("name = 'road 7'"), "all")


@query(f", {_palette_sql('carto')}, s AS ({_style_sql()}) SELECT fid FROM s WHERE __rs_dash IS NULL", ("edges",))
def undashed_edges(spark, sf):
    return filters.undashed(styling.bake(view(spark, sf, "edges"), ClassStyler(palette="carto")), "__rs_dash").select("fid")


@query("SELECT fid, highway, name FROM v_edges WHERE fid = 42", ("edges",))
def select_edge(spark, sf):
    return verbs.select_one(view(spark, sf, "edges"), 42).select("fid", "highway", "name")


@query(ORACLE["annotation_slots"] + " AND slot % 2 = 0 AND name IS NOT NULL")
def name_labels(spark, sf):
    first = F.get("vertices", F.lit(0))
    return graph.name_slots(graph.annotation_slots(_network(spark, sf))).select("chain", "slot", "name", "class", "oneway", F.size("vertices").alias("n_vertices"), first["x"].alias("x"), first["y"].alias("y"))


@query(ORACLE["annotation_slots"] + " AND slot % 2 = 1 AND ow")
def arrow_labels(spark, sf):
    first = F.get("vertices", F.lit(0))
    return graph.arrow_slots(graph.annotation_slots(_network(spark, sf))).select("chain", "slot", "name", "class", "oneway", F.size("vertices").alias("n_vertices"), first["x"].alias("x"), first["y"].alias("y"))


_POINT_TILE = f"SELECT fid, {_MX.format(c='mx')} AS px, {_MY.format(c='my')} AS py FROM v_streets"


@query(f", o AS ({_POINT_TILE}), zs AS (SELECT unnest(range(6, 16)) AS z) SELECT CAST(z AS INT) AS z, {_IDX.format(v='(px + 20037508.342789244)', z='z')} AS x, {_IDX.format(v='(20037508.342789244 - py)', z='z')} AS y, 'stops' AS layer, count(*) AS features FROM o, zs GROUP BY ALL", ("streets",))
def overlay_tile_counts(spark, sf):
    point = F.struct(F.lit("Point").alias("gtype"), F.array(G.line((F.col("mx") / 1e6, F.col("my") / 1e6))).alias("parts"))
    return tiles.tile_counts(tiles.overlay_rows(view(spark, sf, "streets").select("fid", "name", point.alias("geometry")), "stops"))


@query(f", {_STREET_BOX}, c AS (SELECT fid, {_cover_sql('12')} FROM box), t AS (SELECT fid, x, unnest(range(ya, yb + 1)) AS y FROM c) SELECT x, y, count(*) AS edges, min(mx) AS west, max(mx) AS east FROM t JOIN v_streets USING (fid) GROUP BY x, y", ("streets",))
def tile_sidecar_join(spark, sf):
    """What a page looks up for the edges of a tile: their middles, by id from the sidecar."""
    df = edges(spark, sf, "streets")
    side = tiles.sidecar(df.select("fid", "highway", "geometry")).select(F.col("fid").alias("f"), F.col("mid.x").alias("mid"))
    cells = tiles.tile_cover(df.select("fid", G.bounds(G.to_mercator(F.col("vertices"))).alias("box")), F.lit(12))
    mid = G.node_key(F.col("mid"))
    return cells.join(side, F.col("fid") == F.col("f")).groupBy("x", "y").agg(F.count("*").alias("edges"), F.min(mid).alias("west"), F.max(mid).alias("east"))


@query("SELECT * FROM (VALUES ('blocks', 0, 'fill'), ('stops', 1, 'circle'), ('roads2', 2, 'line')) t(name, position, kind)")
def overlay_catalog(spark, sf):
    df = edges(spark, sf, "streets")
    ring = lambda: G.line(*[(F.col(p + "x") / 1e6, F.col(p + "y") / 1e6) for p in "amza"])
    shape = lambda kind, v: df.select(F.struct(F.lit(kind).alias("gtype"), F.array(v).alias("parts")).alias("geometry"))
    over = {"blocks": shape("Polygon", ring()), "stops": shape("Point", G.line((F.col("mx") / 1e6, F.col("my") / 1e6))), "roads2": shape("LineString", F.col("vertices"))}
    return flow.Network(df, "highway", DEFAULT, overlays=over).overlay_catalog(spark)


@query("SELECT fid, row_number() OVER (ORDER BY highway NULLS FIRST, fid) - 1 AS dense, highway, name, aadt, round(ax / 1e6, 6) AS x FROM v_edges", ("edges",))
def dense_ids(spark, sf):
    df = ingest.with_ids(edges(spark, sf).withColumnRenamed("fid", "old"), "highway", "old")
    return df.select(F.col("old").alias("fid"), F.col("fid").alias("dense"), "highway", "name", "aadt", _r(F.get("vertices", F.lit(0))["x"]).alias("x"))


@query(
    f""", {_palette_sql()}, s AS ({_style_sql().replace('v_edges', 'v_streets')}) SELECT '{{"type":"Feature","properties":{{"fid":' || fid || ',"highway":' || to_json(highway) || ',"name":' || coalesce(to_json(name), 'null') || ',"__rs_fill":' || to_json(__rs_fill) || ',"__rs_casing":' || coalesce(to_json(__rs_casing), 'null')
    || '}},"geometry":{{"type":"LineString","coordinates":[[' || ax / 1e6 || ',' || ay / 1e6 || '],[' || mx / 1e6 || ',' || my / 1e6 || '],[' || zx / 1e6 || ',' || zy / 1e6 || ']]}}}}' AS value FROM s JOIN v_streets USING (fid)""",
    ("streets",),
)
def geojson_features(spark, sf):
    return sinks.geojson_rows(styling.bake(edges(spark, sf, "streets"), ClassStyler()).select("fid", "highway", "name", "__rs_fill", "__rs_casing", "geometry"))


def _packed(df):
    """What was packed, from what is unpacked again."""
    text = F.coalesce(blobs.unpack(F.when(F.col("packed"), F.col("data"))), F.col("data"))
    return df.select("chunk", "first", "n_features", "n_bytes", "packed", F.sha2(text, 256).alias("text_sha256"))


@query(
    "WITH one AS (" + ORACLE["geojson_features"].replace("AS value FROM s JOIN", "AS value, fid FROM s JOIN") + """),
    c AS (SELECT fid // 10000 AS chunk, min(fid) AS first, count(*) AS n_features, '{"type":"FeatureCollection","features":[' || string_agg(value, ',' ORDER BY fid) || ']}' AS text FROM one GROUP BY fid // 10000)
    SELECT chunk, first, n_features, CAST(strlen(text) AS BIGINT) AS n_bytes, strlen(text) >= 1000000 AS packed, sha256(text) AS text_sha256 FROM c"""
)
def packed_sources(spark, sf):
    """The streets as a page loads them; chunks of under a million bytes stay text."""
    df = styling.bake(edges(spark, sf, "streets"), ClassStyler()).select("fid", "highway", "name", "__rs_fill", "__rs_casing", "geometry")
    return _packed(blobs.packed_features(df, "roads", min_bytes=1_000_000))


@query(f", {_palette_sql()}, s AS ({_style_sql()}) {_TWOWAY}, r AS (SELECT min(aadt) AS lo, max(aadt) AS hi FROM v_edges WHERE {_BASE} NOT IN ('footway', 'cycleway')) SELECT s.fid, __rs_class, __rs_w, __rs_casing, {_ramp_sql('w.aadt', 'lo', 'hi')} AS fill, w.twoway, CAST({_RANK.replace('highway', 'w.highway').replace('bridge', 'w.bridge').replace('tunnel', 'w.tunnel').replace('layer', 'w.layer')} AS DOUBLE) AS rank FROM s JOIN w ON w.fid = s.fid, r WHERE __rs_class NOT IN ('footway', 'cycleway')", ("edges",))
def flagship(spark, sf):
    """Filter, class style, ramp over the rows that are left, twins, draw order: one plan. The range comes from the edges
    before the twin join, so the only shuffles are the twins' aggregate and join and the one-row range."""
    df = _with_level(view(spark, sf, "edges"))
    kept = lambda d: filters.filter_classes(d, "highway", exclude=["footway", "cycleway"])
    fill = NumericStyler("aadt", RAMP, range_of=kept(df)).apply(kept(graph.mark_twoway(df))).withColumnRenamed("__rs_fill", "fill").drop(*[c for c in STYLE_COLUMNS if c != "__rs_fill"], MISSING)
    styled = styling.bake(fill, ClassStyler()).withColumn("rank", widths.draw_rank(F.col("highway"), F.col("lvl")))
    return styled.select("fid", "__rs_class", _r("__rs_w").alias("__rs_w"), "__rs_casing", "fill", "twoway", "rank")
