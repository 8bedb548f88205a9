"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.sources import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges`` between two columns of one type: the smallest node that it reaches.

    A round gives each node the one of least hash among itself and its neighbours, follows that twice more, and
    contracts the graph to the nodes that were chosen, under another hash: of a path about a third are left, so
    the rounds grow with the logarithm of the nodes and their work falls from one to the next. Afterwards the
    tables of choices are joined from the last to the first. Every table is written, so a lost executor costs one
    round at most, and minima are taken in tasks before the shuffle, so a node with a third of all edges costs no more than others.
    A null end is no node; an edge from a node to itself makes it a component of its own.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    now = written(both.union(both.select("v", "u")).distinct())
    choices: list[DataFrame] = []
    seed = 0
    while not now.isEmpty():
        def ranked(c: str, seed: int = seed) -> F.Column:
            return F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("w"))

        least = now.groupBy("u").agg(F.min(ranked("v")).alias("m"))
        one = written(least.select("u", F.least("m", ranked("u")).getField("w").alias("to")))
        two = _followed(one, one)
        chosen = written(_followed(two, two))
        choices.append(chosen)
        ends = now.where("u <> v").join(chosen, "u").select(F.col("to").alias("x"), F.col("v").alias("u"))
        now = written(ends.join(chosen, "u").select(F.col("x").alias("u"), F.col("to").alias("v")).where("u <> v").distinct())
        seed += 1
    if not choices:
        return both.select(F.col("u").alias("node"), F.col("u").alias("component"))
    labels = choices[-1]
    for chosen in reversed(choices[:-1]):
        # A chosen node without edges left is its own label.
        after = labels.select(F.col("u").alias("to"), F.col("to").alias("label"))
        labels = written(chosen.join(after, "to", "left").select("u", F.coalesce("label", "to").alias("to")))
    least = labels.groupBy("to").agg(F.min("u").alias("component"))
    return labels.join(least, "to").select(F.col("u").alias("node"), "component")


def _followed(choice: DataFrame, then: DataFrame) -> DataFrame:
    """(u, to): where ``then`` leads from what ``choice`` has chosen; every chosen node has a choice itself."""
    return choice.join(then.select(F.col("u").alias("to"), F.col("to").alias("next")), "to").select("u", F.col("next").alias("to"))
