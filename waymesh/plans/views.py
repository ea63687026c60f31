"""Edge tables made from the test tables by exact integer arithmetic. One SQL text serves Spark and the SQL oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions.geometry import line

_LON, _LAT = "17900000 + ({n} * 7919) % 300000", "59200000 + ({n} * 10473) % 150000"

VIEWS = {
    "edges": f"""
        SELECT fid, a, z, highway, name, aadt, oneway, bridge, tunnel, layer,
            {_LON.format(n="a")} AS ax, {_LAT.format(n="a")} AS ay, {_LON.format(n="z")} AS zx, {_LAT.format(n="z")} AS zy
        FROM (SELECT o_orderkey AS fid, o_custkey AS a, (o_orderkey * 7) % 1500 AS z,
            CASE o_orderkey % 16 WHEN 0 THEN 'motorway' WHEN 1 THEN 'motorway_link' WHEN 2 THEN 'trunk' WHEN 3 THEN 'primary' WHEN 4 THEN ' PRIMARY '
                WHEN 5 THEN 'Secondary_link' WHEN 6 THEN 'tertiary' WHEN 7 THEN 'residential' WHEN 8 THEN 'service' WHEN 9 THEN 'footway' WHEN 10 THEN 'cycleway'
                WHEN 11 THEN 'unheard_of' WHEN 12 THEN NULL WHEN 13 THEN '' WHEN 14 THEN 'living_street' ELSE 'track' END AS highway,
            CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 'nan' ELSE 'road ' || (o_orderkey % 97) END AS name,
            CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS aadt,
            CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS oneway,
            CASE o_orderkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'no' WHEN 3 THEN '' WHEN 4 THEN 'TRUE' END AS bridge,
            CASE o_orderkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'false' WHEN 2 THEN '0' WHEN 3 THEN 'T' END AS tunnel,
            CASE o_orderkey % 6 WHEN 0 THEN '3' WHEN 1 THEN '-2' WHEN 2 THEN '1.7' WHEN 3 THEN 'x' END AS layer
            FROM {{orders}}) AS o""",
    "chain": """
        SELECT event_id AS fid, event_id AS a, event_id + 1 + CASE WHEN event_id % 5 = 0 THEN 24 ELSE 0 END AS z, event_type AS highway, value,
            CASE WHEN event_id % 2000 < 1000 THEN 'north' END AS name, event_id % 4000 < 500 AS ow
        FROM {events}""",
    # Streets of seven edges, each a line of three vertices; some with their way back, some one-way, some with a bridge.
    "streets": """
        SELECT fid, k, j, twice, a, z, 17000000 + (k % 800) * 9000 + (CASE WHEN twice = 0 THEN j ELSE j + 1 END) * 1100 AS ax, 58000000 + (k DIV 800) * 5000 + (CASE WHEN twice = 0 THEN j % 2 ELSE (j + 1) % 2 END) * 400 AS ay,
            17000000 + (k % 800) * 9000 + j * 1100 + 550 AS mx, 58000000 + (k DIV 800) * 5000 + 700 AS my,
            17000000 + (k % 800) * 9000 + (CASE WHEN twice = 0 THEN j + 1 ELSE j END) * 1100 AS zx, 58000000 + (k DIV 800) * 5000 + (CASE WHEN twice = 0 THEN (j + 1) % 2 ELSE j % 2 END) * 400 AS zy,
            CASE WHEN k % 3 = 0 THEN NULL ELSE 'street ' || k END AS name, CASE k % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN 'tertiary' ELSE 'motorway' END AS highway,
            CASE WHEN k % 5 = 1 THEN 'yes' WHEN k % 5 = 2 THEN 'no' END AS oneway, CASE WHEN k % 2 = 0 AND j BETWEEN 2 AND 4 THEN 'yes' END AS bridge, CAST(NULL AS STRING) AS tunnel, CAST(NULL AS STRING) AS layer
        FROM (SELECT event_id * 2 + twice AS fid, event_id DIV 7 AS k, event_id % 7 AS j, twice, event_id DIV 7 * 8 + event_id % 7 + twice AS a, event_id DIV 7 * 8 + event_id % 7 + 1 - twice AS z
            FROM {events} CROSS JOIN (SELECT 0 AS twice UNION ALL SELECT 1) t WHERE twice = 0 OR (event_id DIV 7) % 5 >= 2) e""",
    "colors": """
        SELECT 2 * CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 1 ELSE p_partkey END AS id, p_partkey AS place,
            CASE p_partkey % 4 WHEN 0 THEN '#ff0000' WHEN 1 THEN ' teal ' WHEN 2 THEN '' END AS color FROM {part}""",
    "dirty": """
        SELECT event_id AS fid, value, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN upper(event_type) WHEN event_id % 17 = 0 THEN ' ' || event_type || ' ' ELSE event_type END AS kind,
            CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS maybe FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", VIEWS[name])}
    return spark.sql(VIEWS[name], **tables)


def view_sql(*names: str) -> str:
    """WITH clauses v_name for the oracle."""
    plain = lambda n: re.sub(r"[{](\w+)[}]", r"\1", VIEWS[n]).replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR")
    return "WITH " + ", ".join(f"v_{n} AS ({plain(n)})" for n in names)


def edges(spark: SparkSession, sf_dir: str, name: str = "edges") -> DataFrame:
    """The edges view, or that of streets, with vertices and geometry."""
    degree = lambda c: F.col(c) / 1e6
    v = line(*[(degree(f"{n}x"), degree(f"{n}y")) for n in ("amz" if name == "streets" else "az")])
    df = view(spark, sf_dir, name).withColumn("vertices", v)
    return df.withColumn("geometry", F.struct(F.lit("LineString").alias("gtype"), F.array("vertices").alias("parts")))
