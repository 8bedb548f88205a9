"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target divided by its size is the number of times each of its documents should be taken. The whole
part is taken outright. The rest, a probability, is rounded by pivoting: two documents with fractional
probabilities exchange words, one gaining what the other loses, until one of them is taken or not; a hash
decides the direction with the odds that keep every document's expectation. The exchange keeps the source's
expected words, so after all of them the source misses its target by less than one document. Larger ones
go first: they settle against each other, and what is open at the end tends to be a small one.

Exchanges run as a reduction tree: a leaf is a small hash group of a source's documents, folded one by one
into a residual; residuals of leaves are grouped again, until one is left, which is rounded to the nearer side. Leaves are
bounded, so a source with a third of all documents only has more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.shared import WORD, cut

#: Tolerance on probabilities: within it a probability counts as 0 or 1.
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from ``sizes`` of (source, source_size), one row a source.

    Sources in code point order, null last, weigh ``weights``, repeating. They share the sum of all sizes by
    weight; a target stops at ``most`` times its source's size and the excess is shared again by weight
    among the others, until none is above. With sources ordered by size per weight, that is one level: the
    first sources up to some rank stop, and the others share the rest by weight.

    The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.hex(F.encode("source", "UTF-8")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rank = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.hex(F.encode("source", "UTF-8")))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    # The level if this source and those after it all share what the earlier ones leave.
    w = w.withColumn("level", F.col("rest") / F.sum("w").over(after))
    # The first source that this level does not stop; the earlier ones stop at it, the later ones share it too.
    open_ = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), "level"))
    target = F.least(F.min(open_).over(everything)["level"] * F.col("w"), F.col("cap"))
    return w.select("source", "source_size", F.coalesce(target, F.col("cap")).alias("target"))


def _uniform(level: Column, seed: int) -> Column:
    """A number in [0, 1) from a unit's key, the same in every run."""
    return F.pmod(F.xxhash64("key", level, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fold(units: Column) -> Column:
    """Pivot the units of an array one after the other: struct(left, done).

    ``left`` is the unit still fractional, or null; ``done`` has the others with p of 0 or 1.
    """
    unit = "struct<order:bigint,doc_id:bigint,key:bigint,size:bigint,whole:bigint,p:double,u:double>"
    start = F.struct(F.lit(None).cast(unit).alias("left"), F.array().cast(f"array<{unit}>").alias("done"))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["order"].alias("order"), x["doc_id"].alias("doc_id"), x["key"].alias("key"), x["size"].alias("size"), x["whole"].alias("whole"), p.alias("p"), x["u"].alias("u"))

    def step(acc: Column, y: Column) -> Column:
        x = acc["left"]
        up = F.least((1 - x["p"]) * x["size"], y["p"] * y["size"])  # words that x can gain from y
        down = F.least(x["p"] * x["size"], (1 - y["p"]) * y["size"])
        gain = F.when(y["u"] * (up + down) < down, up).otherwise(-down)

        def settled(p: Column) -> Column:
            return F.when(p < _EPS, 0.0).when(p > 1 - _EPS, 1.0).otherwise(p)

        px, py = settled(x["p"] + gain / x["size"]), settled(y["p"] - gain / y["size"])
        moved = F.struct(with_p(x, px).alias("x"), with_p(y, py).alias("y"))

        def place(m: Column) -> Column:
            a, b = m["x"], m["y"]
            x_open, y_open = (a["p"] > 0) & (a["p"] < 1), (b["p"] > 0) & (b["p"] < 1)
            # At least one is settled; only rounding could leave both open, and then the second waits no longer.
            left = F.when(x_open, a).when(y_open, b)
            done = F.when(x_open, F.array(with_p(b, F.round(b["p"])))).when(y_open, F.array(a)).otherwise(F.array(a, b))
            return F.struct(left.alias("left"), F.concat(acc["done"], done).alias("done"))

        first = F.struct(y.alias("left"), acc["done"].alias("done"))
        return F.when(x.isNull(), first).otherwise(F.element_at(F.transform(F.array(moved), place), 1))

    return F.aggregate(units, start, step)


def mix(df: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0, leaf: int = 48, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``df``.

    size counts the words of the whole text, none in a null one; taken is copies times size, and copies at
    most ``most``. Documents without words are never taken. A null source is a source. Rows that repeat an
    id are documents of their own, rounded apart. An empty table gives an empty frame. The same rows and
    seed give the same result in any partitioning. Other columns are not read.
    """
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    docs = cut(docs)
    shares = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    shares = cut(shares.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    n = docs.where("size > 0").groupBy("source").agg(F.count("*").alias("n_docs"))
    shares = shares.withColumnRenamed("source", "s").join(n.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
    units = docs.join(shares, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(F.col("copies") + _EPS)
    units = units.withColumn("whole", whole.cast("long")).withColumn("p", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)))
    fractional = (F.col("size") > 0) & (F.col("p") > _EPS)
    keep = ["source", "source_size", "target"]
    settled = units.where(~F.coalesce(fractional, F.lit(False))).select("doc_id", *keep, "size", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies"))
    now = units.where(fractional).select(*keep, "doc_id", F.xxhash64("doc_id", "size").alias("key"), "size", "whole", "p", F.ceil(F.col("n_docs") / leaf).alias("groups"))

    level, done, most_groups = 0, [settled], shares.agg(F.max(F.ceil(F.col("n_docs") / leaf))).first()[0] or 0
    while most_groups:
        now = now.withColumn("u", _uniform(F.lit(level), seed)).withColumn("g", F.pmod(F.xxhash64("key", F.lit(level), F.lit(~seed)), F.col("groups")))
        unit = F.struct((-F.col("size")).alias("order"), "doc_id", "key", "size", "whole", "p", "u")
        grouped = now.groupBy(*keep, "groups", "g").agg(F.array_sort(F.collect_list(unit)).alias("units"))
        folded = cut(grouped.select(*keep, "groups", _fold(F.col("units")).alias("r")))
        out = folded.select(*keep, F.explode("r.done").alias("x"))
        done.append(out.select("x.doc_id", *keep, "x.size", (F.col("x.whole") + F.col("x.p").cast("long")).alias("copies")))
        now = folded.where("r.left is not null").select(*keep, "r.left.doc_id", "r.left.key", "r.left.size", "r.left.whole", "r.left.p", "groups")
        if most_groups == 1:
            # One residual a source: it is rounded to the nearer side, so the source ends nearest to its target.
            copies = F.col("whole") + F.when(F.col("p") >= 0.5, 1).otherwise(0)
            done.append(now.select("doc_id", *keep, "size", copies.alias("copies")))
            break
        most_groups = -(-most_groups // leaf)
        now = now.withColumn("groups", F.ceil(F.col("groups") / leaf))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
