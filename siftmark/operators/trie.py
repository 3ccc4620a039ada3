"""Prefix tries of code lists as edge tables, and beam search over them as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(codes: DataFrame) -> DataFrame:
    """(prefix, next): every different prefix of the code lists with the codes that may follow.

    Lists are made distinct first. Null and empty lists have no edges.
    """
    one = codes.select("codes").where(F.size("codes") > 0).distinct()
    p = one.select("codes", F.explode(F.sequence(F.lit(1), F.size("codes"))).alias("n"))
    return p.select(F.slice("codes", F.lit(1), F.col("n") - 1).alias("prefix"), F.element_at("codes", F.col("n")).alias("next")).distinct()


def allowed(prefixes: DataFrame, trie: DataFrame) -> DataFrame:
    """(prefix, next): what may follow each of ``prefixes``; null stands for the end, which is all that may
    follow a leaf or what is no prefix."""
    return prefixes.select("prefix").distinct().join(trie, "prefix", "left").select("prefix", "next")


def beam_search(queries: DataFrame, trie: DataFrame, score: DataFrame, levels: int, beams: int = 10) -> DataFrame:
    """(query, rank, codes, total): the ``beams`` best full paths of the trie for every query.

    ``score`` has query, level, code and s, the score of a code at a level; codes without one score null
    and are not taken. Each level is a join with the trie, a join with the scores and a top-k for each
    query; equal totals: smaller codes first. Paths that end before ``levels`` are kept as they are.
    """
    state = queries.select("query", F.array().cast("array<int>").alias("codes"), F.lit(0.0).alias("total"))
    order = Window.partitionBy("query").orderBy(F.desc("total"), "codes")
    step = trie.select(F.col("prefix").alias("codes"), "next")
    # all queries start from the empty prefix: its edges, one for each first code, go to the queries
    root = F.broadcast(step.where(F.size("codes") == 0))
    for level in range(levels):
        # merged, as scores made by exploding a small table are taken for small too, and would all be broadcast by the driver
        at = score.where(F.col("level") == level).select("query", F.col("code").alias("next"), "s").hint("merge")
        met = state.join(root if level == 0 else step.where(F.size("codes") == level), "codes", "left").join(at, ["query", "next"], "left")
        # a leaf has no edge, and stays as it is
        leaf = F.col("next").isNull()
        met = met.where(leaf | F.col("s").isNotNull())
        codes = F.when(leaf, F.col("codes")).otherwise(F.concat("codes", F.array("next")))
        total = F.when(leaf, F.col("total")).otherwise(F.round(F.col("total") + F.col("s"), 9))
        state = met.select("query", codes.alias("codes"), total.alias("total")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= beams).drop("r")
    return state.select("query", F.row_number().over(order).cast("long").alias("rank"), "codes", "total")
