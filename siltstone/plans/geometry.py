"""Queries over boxes, rebuilt tables and flows, on boxes made of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial
from .common import Registry, table

REGISTRY = Registry()
add = REGISTRY.add
_BOX = "l_partkey % 50 * 10.0::DOUBLE AS x, l_suppkey % 40 * 10.0::DOUBLE AS y, l_quantity * 2 AS w, l_linenumber * 5.0::DOUBLE AS h"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50 * 10.0).alias("x"), (F.col("l_suppkey") % 40 * 10.0).alias("y"), (F.col("l_quantity") * 2).alias("w"), (F.col("l_linenumber") * 5.0).alias("h")).distinct()
    return lines.select("l_orderkey", "l_linenumber", F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("bbox"))


_PAIRS = f"""WITH b AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, {_BOX} FROM lineitem), p AS (SELECT a.k, a.n AS i, b.n AS j, a.x AS ax, a.y AS ay, a.x + a.w AS az, a.y + a.h AS aw, b.x AS bx, b.y AS by_, b.x + b.w AS bz, b.y + b.h AS bw FROM b a JOIN b b ON a.k = b.k AND a.n < b.n)"""


@add(f"""{_PAIRS} SELECT k AS l_orderkey, i, j, round(sqrt(power(greatest(ax - bz, bx - az, 0), 2) + power(greatest(ay - bw, by_ - aw, 0), 2)), 6) AS distance,
    round(greatest(0, least(az, bz) - greatest(ax, bx)) * greatest(0, least(aw, bw) - greatest(ay, by_)) / greatest(1.0::DOUBLE, least((az - ax) * (aw - ay), (bz - bx) * (bw - by_))), 6) AS overlap,
    (ax + az) / 2 BETWEEN bx AND bz AND (ay + aw) / 2 BETWEEN by_ AND bw AS inside FROM p""")
def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    pairs = boxes.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("bbox").alias("a")).join(boxes.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("bbox").alias("b")), "l_orderkey").where("i < j")
    a, b = F.col("a"), F.col("b")
    return pairs.select("l_orderkey", "i", "j", F.round(spatial.box_distance(a, b), 6).alias("distance"), F.round(spatial.overlap_ratio(a, b), 6).alias("overlap"), spatial.center_inside(a, b).alias("inside"))


@add(f"""WITH b AS (SELECT DISTINCT l_orderkey, {_BOX} FROM lineitem) SELECT l_orderkey, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM b GROUP BY l_orderkey""")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    return spatial.union_box(_boxes(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1"))


