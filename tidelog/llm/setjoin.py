"""All links between sets by Jaccard similarity, as a sparse product with its own transpose.

A set is a row of items in one global order, rarest first. Two sets that are similar enough share an item among their
first few, so only those columns of the incidence matrix are multiplied: equal columns meet in a join, and what each pair
has in common adds up in a group-by. Pairs that can't reach the least overlap, by their sizes, by how many items they may meet elsewhere, or by
how far down they meet, are discarded; those left are counted exactly.

Groups of near copies would make a product of all pairs. So each column first meets its most central set alone; what links
there makes components. The full product then leaves out pairs within a component, whose link would change nothing, and pairs
that share too little beyond what their common centre has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.storage import Scope


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def least_overlap(n_a: Column, n_b: Column, num: int, den: int) -> Column:
    """The smallest overlap of sets of these sizes for which den * overlap >= num * union."""
    return _ceil_div(num * (n_a + n_b), num + den)


def prefix_length(n: Column, shared: Column, num: int, den: int) -> Column:
    """How many of the ``shared`` items of a set of ``n``, rarest first, a similar set must meet; items met nowhere else come before."""
    return shared - _ceil_div(num * n, den) + 1


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, n_a, n_b, overlap)`` of pairs of nodes, counted exactly."""
    mine = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("items").alias(f"items_{x}"))
    both = pairs.join(mine("b"), "b").join(mine("a"), "a")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("overlap"))


def _linked(counted: DataFrame, num: int, den: int) -> DataFrame:
    return counted.where(F.col("overlap") >= least_overlap(F.col("n_a"), F.col("n_b"), num, den)).select("a", "b")


def length_bands(n: Column, num: int, den: int) -> Column:
    """The bands of lengths in which a set meets others: its own and the next. Sets that can link are in the same or in neighbouring bands."""
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num)) + 1e-9)
    return F.array(band, band + 1)


def linked_components(sets: DataFrame, num: int = 3, den: int = 4, banded: bool = False, scope: Scope | None = None) -> DataFrame:
    """``(node, component)`` of the sets that are linked with any other: den * intersection >= num * union.

    ``sets(node long, n long, shared long, score int, items array<long>)`` holds different sets: ``n`` is the size of all,
    ``items`` the ``shared`` items that may be met elsewhere, in the global order, and ``score`` is high for sets of frequent items. With ``banded``, columns are
    split by bands of set lengths; overlaps may then be counted twice, which discards no more pairs than counting them once.

    What is known of a column is stored before its entries meet it, so joins by column read plain shuffles, and Spark splits a column that very many sets have.
    """
    scope = Scope.of(scope, sets)
    sized = sets.withColumn("p", prefix_length(F.col("n"), F.col("shared"), num, den)).where("p > 0")
    entry = F.struct("node", "n", "shared").alias("x")
    entries = sized.select(F.posexplode(F.slice("items", 1, F.col("p").cast("int"))).alias("pos", "item"), "score", entry)
    if banded:
        entries = entries.withColumn("band", F.explode(length_bands(F.col("x.n"), num, den))).withColumn("item", F.xxhash64("item", "band")).drop("band")
    least = least_overlap(F.col("a.n"), F.col("b.n"), num, den)

    # Each column's most central set meets the others of the column.
    centres = entries.groupBy("item").agg(F.max(F.struct("score", "x")).alias("top"), F.count("*").alias("k")).where("k > 1").select("item", F.col("top.x").alias("a"))
    centres = scope.stored(centres, "centres")
    star = centres.join(entries.select("item", F.col("x").alias("b")), "item").where(F.col("a.node") != F.col("b.node")).where(F.least("a.shared", "b.shared") >= least)
    star = scope.stored(_overlaps(star.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), sets), "star")
    scope.drop(centres)
    first = _linked(star, num, den)
    at_first = components(first, scope)

    # What is known of each set: its component, the centre that it overlaps most (itself, if it is one), and by how much.
    best = star.groupBy("b").agg(F.max(F.struct("overlap", "a")).alias("best")).select(F.col("b").alias("node"), "best")
    heads = star.select(F.col("a").alias("node")).distinct().withColumn("head", F.lit(True))
    known = sized.select("node", "shared").join(best, "node", "left").join(heads, "node", "left").join(at_first, "node", "left")
    alone = F.col("head").isNotNull() | F.col("best").isNull()
    known = known.select(
        "node",
        F.coalesce("component", "node").alias("c"),
        F.when(alone, F.col("node")).otherwise(F.col("best.a")).alias("centre"),
        F.when(alone, F.col("shared")).otherwise(F.col("best.overlap")).alias("of_centre"),
    )
    x = F.struct("x.node", "x.n", "x.shared", "pos", "c", "centre", "of_centre").alias("x")
    labelled = scope.stored(entries.drop("score").withColumn("node", F.col("x.node")).join(known, "node").select("item", x), "entries")

    # The product: over columns with several components, of sets that could still meet the smallest set of the column so far down.
    open_items = labelled.groupBy("item").agg(F.min("x.c").alias("lo"), F.max("x.c").alias("hi"), F.min("x.n").alias("n_lo")).where("lo < hi").select("item", "n_lo")
    open_items = scope.stored(open_items, "open_items")
    reach = F.col("x.shared") - least_overlap(F.col("x.n"), F.col("n_lo"), num, den)
    still = scope.stored(labelled.join(open_items, "item").where(F.col("x.pos") <= reach).select("item", "x"), "still")
    scope.drop(labelled, open_items)
    product = still.select("item", F.col("x").alias("a")).join(still.select("item", F.col("x").alias("b")), "item").where(F.col("a.c") < F.col("b.c"))
    # Of two similar sets, the first item that they share is as early as this in both.
    product = product.where((F.col("a.pos") <= F.col("a.shared") - least) & (F.col("b.pos") <= F.col("b.shared") - least))
    # Two sets share no more than what both have of a common centre, and of what it hasn't.
    within = F.least("a.of_centre", "b.of_centre") + F.least(F.col("a.shared") - F.col("a.of_centre"), F.col("b.shared") - F.col("b.of_centre"))
    product = product.where((F.col("a.centre") != F.col("b.centre")) | (within >= least))
    second = product.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.count("*").alias("met")).drop("met")
    links = scope.stored(first.union(_linked(_overlaps(second, sets), num, den)), "links")
    scope.drop(star, still)
    return components(links, scope)
