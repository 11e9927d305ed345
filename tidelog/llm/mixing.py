"""Mix sources to target weights, with DataFrame functions only.

Sizes are summed per source, each source gets a target from its weight, and a document is emitted ``floor(rate)``
times, plus once more with probability ``rate - floor(rate)`` by a draw that is a pure hash of seed and id: reruns agree,
and no state is kept. One row per source is all that is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import Scope
from tidelog.names import unused
from tidelog.operators.ids import numbered, running_sums

WORD = r"[^\x20\x09-\x0D]+"
#: Up to this many sources (some MB of rows) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a digest of ``seed`` and ``key``; a null key counts as the text ``null``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float, scope: Scope | None = None) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``.

    Sources in code-point order, null last, take the weights in turn. Targets share the sum of all sizes by weight; none is
    above ``most`` times its source's size, and what is cut off goes to the others by weight, until none is above. In order of
    size per weight the sources that are cut come first, so running sums find where cutting ends in one pass. Sources are sorted by range: there may be
    as many as documents.
    """
    scope = Scope.of(scope, sizes)
    ranked, count = numbered(sizes.select("source", F.isnull("source").alias("last"), "source_size"), ("last", "source"), "rank", scope.place("ranked"))
    turn = (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")
    weighted = ranked.select("source", "source_size", "rank", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn).alias("weight"))
    if not count:
        return weighted.select("source", "source_size", F.lit(0.0).alias("target"))
    fill = F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), "rank").alias("fill")
    filled = running_sums(weighted.withColumn("fill", fill), ("fill",), {"cut_size": "source_size", "cut_weight": "weight"}, scope.place("summed"))
    filled = scope.stored(filled, "filled")
    # One row is gathered here, and one below.
    every = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    ceiling = F.lit(float(most)) * F.col("source_size")
    level = (F.lit(every["size"]) - F.lit(float(most)) * F.col("cut_size")) / (F.lit(every["weight"]) - F.col("cut_weight"))
    first = filled.withColumn("level", level).where(F.col("level") * F.col("weight") <= ceiling).agg(F.min(F.struct("fill", "level")).alias("open")).first()["open"]
    if first is None:
        target = ceiling
    else:
        start = F.struct(F.lit(first["fill"]["ratio"]).alias("ratio"), F.lit(first["fill"]["rank"]).alias("rank"))
        target = F.when(F.col("fill") < start, ceiling).otherwise(F.least(F.lit(first["level"]) * F.col("weight"), ceiling))
    return filled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


ADDED = ("size", "source_size", "target", "rate", "copies")


def _planned(docs: DataFrame, names: Sequence[str], weights: Sequence[float], most: float, seed: str, id_col: str, text_col: str, source_col: str, scope: Scope) -> DataFrame:
    """``docs`` with the columns ``ADDED``, under ``names``, which it hasn't."""
    size, source_size, target, rate, copies = names
    source = F.col(f"`{source_col}`").cast("string")
    sizes = docs.select(source.alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    (key,) = unused([*docs.columns, *names], "source_key")
    targets = scope.stored(source_targets(sizes, weights, most, scope), "targets").select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    if targets.count() <= MOST_BROADCAST:
        targets = F.broadcast(targets)
    limited = F.least(F.coalesce(F.col(target) / F.nullif(F.col(source_size), F.lit(0)), F.lit(0.0)), F.lit(float(most)))
    whole = F.floor(F.col(rate))
    more = F.when(draw(seed, F.col(f"`{id_col}`")) < F.col(rate) - whole, 1).otherwise(0)
    found = docs.join(targets, source.eqNullSafe(F.col(key))).withColumns({size: word_count(F.col(f"`{text_col}`")), rate: limited})
    return found.withColumn(copies, (whole + more).cast("long")).drop(key)


def plan_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scope: Scope | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``, replacing columns of these names.

    A null or empty text has size 0; a null source is a source of its own; sources whose texts are all empty have rate 0. Rows that
    share an id share their draw, so repeated rows are taken alike. No rows give no rows.
    """
    names = unused(docs.columns, *ADDED)
    planned = _planned(docs, names, weights, most, seed, id_col, text_col, source_col, Scope.of(scope, docs))
    return planned.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED], *[F.col(n).alias(c) for n, c in zip(names, ADDED)])


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scope: Scope | None = None) -> DataFrame:
    """Each document as often as :func:`plan_mix` says, with the columns of ``docs`` alone, whose values stay as they are."""
    names = unused(docs.columns, *ADDED)
    planned = _planned(docs, names, weights, most, seed, id_col, text_col, source_col, Scope.of(scope, docs))
    (number,) = unused(planned.columns, "number")
    taken = planned.where(F.col(names[-1]) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[-1]))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
