"""Find licence texts by the digest of their canonical form, with DataFrame functions only.

A text is made canonical once, line by line (case, copyright and title lines, equivalent spellings, punctuation and white space), and its digest is
joined with the digests of known texts. Whole documents, their paragraphs and their lines are looked up: a licence file matches
as a whole, however it is wrapped, what source files begin with as a paragraph, a notice as a line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.known_licenses import DIGESTS, EQUIVALENT, HEADERS, IDENTIFIERS, TEXTS, TITLES
from tidelog.names import unused

#: A line that begins with a copyright sign, or with the word and then a sign, a year, a bracket or the name of a company: other lines are a part of the text.
COPYRIGHT_LINE = (
    r"(?md)^[^\p{L}\p{N}©(\n]*(?:copyright(?:[^\p{L}\p{N}\n]*(?:[©<{\[]|c\)|\d|by[^\p{L}\p{N}\n])|[^\n]*(?:19|20)\d\d|[^\n]*(?:inc|llc|ltd|corporation|foundation)[^\p{L}\p{N}\n]*$)"
    r"|\(c\)[^\p{L}\p{N}\n]*(?:copyright|\d{4})|©)[^\n]*$"
)
RESERVED_LINE = r"(?md)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
#: Up to this many known texts (a few MB of digests) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 20_000


def _any(text: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def with_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the ``lines`` and ``paragraphs`` of a text that have words, in lower case and one spelling, with single spaces; without copyright and title lines. Null has none.

    A line that begins with the word copyright is one for its sign, year or company, and wherever only such lines stand before it. Lines without words end a paragraph.
    A step is a column of its own, since what several conditions read would be made again for each.
    """
    (step,) = unused([*df.columns, "lines", "paragraphs"], "step")
    text = F.col(step)
    # Most texts have none of these, and a look for them is cheaper than their removal.
    plain = F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, ""), RESERVED_LINE, "")
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EQUIVALENT])
    word = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), x, F.lit(r"(?![\p{L}\p{N}])"))
    any_of = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(a for a, _ in EQUIVALENT)})"
    mapped = F.aggregate(pairs, text, lambda t, p: F.when(F.contains(t, p["a"]), F.regexp_replace(t, word(p["a"]), p["b"])).otherwise(t))
    out = df.withColumn(step, F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    out = out.withColumn(step, F.when(_any(text, ("copyright", "(c)", "©", "all rights reserved")), plain).otherwise(text))
    out = out.withColumn(step, F.when(text.rlike(any_of), mapped).otherwise(text))
    lines = F.transform(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda x: F.trim(x))
    out = out.withColumn(step, F.transform(lines, lambda x: F.when(x.isin(*TITLES), "").otherwise(x)))
    full = F.filter(F.col(step), lambda x: x != "")
    begin = F.array_position(F.transform(full, lambda x: ~F.startswith(x, F.lit("copyright"))), True).cast("int")
    own = F.when(begin == 0, F.array().cast("array<string>")).when(begin == 1, full).otherwise(F.slice(full, begin, F.size(full)))
    paragraphs = F.filter(F.split(F.array_join(F.col(step), "\n"), "\n\n+"), lambda x: (x != "") & (x != "\n"))
    return out.withColumns({"lines": own, "paragraphs": paragraphs}).drop(step)


def digest(lines: Column) -> Column:
    """Of :func:`with_lines`, without spaces: words may be joined, hyphenated or broken across lines."""
    return F.sha2(F.translate(F.array_join(lines, ""), " \n", ""), 256)


def known_digests(spark: SparkSession, texts: Sequence[tuple[str, str]] = (*TEXTS, *HEADERS, *IDENTIFIERS), digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """One row per digest: the first name, by code point, of the known texts that have it; texts are given as such or by their digest."""
    rows = spark.createDataFrame([tuple(x) for x in texts], "license string, text string")
    rows = with_lines(rows).select("license", digest(F.col("lines")).alias("digest"))
    if digests:
        rows = rows.union(spark.createDataFrame([tuple(x) for x in digests], "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of whole texts and of their parts, one row per id and canonical text.

    Returns doc_id, ``digest`` of the whole canonical text, ``license`` that it equals (or null), ``line_licenses`` (sorted names of
    the licences that a line or paragraph equals), ``licenses`` (both, sorted) and ``n_rows``, the number of rows that it stands for: repeated rows
    are counted, not repeated. A null or empty text has the digest of the empty text and no licence; so has a text of copyright
    lines alone. Other columns are left out. No rows give no rows.
    """
    if known.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    own = with_lines(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).select("doc_id", "lines", "paragraphs", digest(F.col("lines")).alias("digest"))
    unit = lambda d, whole: F.struct(d.alias("d"), F.lit(whole).alias("whole"))
    # A paragraph of one line is looked up as that.
    parts = F.concat("lines", F.filter("paragraphs", lambda x: F.contains(x, F.lit("\n"))))
    units = F.concat(F.array(unit(F.col("digest"), True)), F.transform(parts, lambda x: unit(digest(F.array(x)), False)))
    each = own.select("doc_id", "digest", F.explode(units).alias("unit")).select("doc_id", "digest", "unit.d", "unit.whole")
    found = each.join(known.select(F.col("digest").alias("d"), "license"), "d", "left").where("whole OR license IS NOT NULL")
    names = F.sort_array(F.collect_set("license"))
    return found.groupBy("doc_id", "digest").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("line_licenses"),
        names.alias("licenses"),
        F.count_if("whole").alias("n_rows"),
    )
