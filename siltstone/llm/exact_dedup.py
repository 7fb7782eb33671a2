"""Exact dedup by distributed MSD radix partitioning.

Every round splits the groups that are left by their next block of bytes. A block is the digit itself, not a digest
of it. Blocks grow sixteenfold from round to round, so a text of n bytes takes about log16(n) rounds. A group that has
one member, or whose members have ended, leaves with its result; only members of the other groups go on, with the
bytes that are left. Counting a digit is an aggregation with partial sums, so a group that holds a third of all
rows costs one row for each map task. The groups that go on are written with a number each, which is their identity in
the next round, and are handed back by a merge join of plain tables, which Spark splits where a group is hot. It is a
merge join at every size, so that what a round costs is in proportion to its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, small_batches

SPACES = r"[\x20\x09-\x0D]+"
FIRST_BLOCK = 128
GROWTH = 16
LARGEST_BLOCK = 1 << 22


def normalised(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text with one space for each run of ASCII white space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ").cast("binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after each run of ASCII white space became one space; null counts as the
    empty text. Rows that repeat the smallest doc_id with the same text are all marked kept. A null doc_id counts as
    larger than any other: it is keep_id only where all members of the group have none, and then all are kept. Other
    columns are ignored. An empty table gives an empty table.
    """
    active = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("rest")).select("doc_id", F.sha2("rest", 256).alias("text_sha256"), F.lit(0).cast("long").alias("gid"), "rest")
    width, finished, left = FIRST_BLOCK, [], None
    while True:
        key = ["gid", "block", "ended"]
        keyed = active.withColumns({"block": F.substring("rest", 1, width), "ended": F.octet_length("rest") <= width})
        # written, so that each group has one number for good and the join sees plain tables, whose hot keys it can split
        groups = cut(keyed.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").withColumn("number", F.monotonically_increasing_id()), "groups", None if left is None else left * (width + 64))
        split = keyed.join(groups.hint("merge"), key, "left").select(
            "doc_id",
            "text_sha256",
            F.coalesce("keep_id", F.when(F.col("n").isNull(), F.col("doc_id"))).alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("group_size"),
            (F.col("n").isNull() | F.col("ended")).alias("done"),
            "number",
            F.when(F.col("n").isNotNull() & ~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        )
        level = cut(split, f"level{len(finished)}")
        drop(groups)
        finished.append(level.where("done").select("doc_id", "keep_id", "group_size", "text_sha256"))
        going = level.where("not done")
        left = going.count()
        if not left:
            break
        active = going.select("doc_id", "text_sha256", F.col("number").alias("gid"), "rest")
        width = min(width * GROWTH, LARGEST_BLOCK)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
