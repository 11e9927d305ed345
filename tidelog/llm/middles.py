"""Fill-in-the-middle: documents cut into prefix, middle and suffix at whole units, and put together again in another order.

Where a unit ends is found eight bytes at a time, in the words of 64 bits that a run of UTF-8 texts is read as: arithmetic marks the bytes that
end a unit, all in a word at once, and counting the marks of each word makes a running count. The k-th unit of a text ends in the
word that the running count reaches k in; which byte of it, the sums of the word's own marks tell. Cuts alone come out of Python, so texts are
put together by Spark and never sent back.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.words import sliced

EACH, TOP, LOWER = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("line", "char")


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, filled up with zeros; one word more than it takes."""
    out = np.zeros(len(data) // 8 + 2, "<u8")
    out.view(np.uint8)[: len(data)] = data
    return out


def line_ends(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is a line feed."""
    apart = words ^ (EACH * np.uint64(10))
    return ~(((apart & LOWER) + LOWER) | apart) & TOP


def continuations(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that goes on with a character."""
    return words & ~(words << np.uint64(1)) & TOP


def char_ends(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that the next byte doesn't go on with."""
    begins = ~continuations(words) & TOP
    return (begins >> np.uint64(8)) | (np.append(begins[1:], TOP) << np.uint64(56))


class Marks:
    """Marked bytes, counted and found by number."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bytes before each of ``at`` are marked."""
        word, bits = at >> 3, (8 * (at & 7)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.marks[word] & ((np.uint64(1) << bits) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th marked byte is, counted from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left = (k - self.before[word]).astype(np.uint64)
        # Each byte has the marks up to it; those that reach what is left keep their top bit.
        upto = (self.marks[word] >> np.uint64(7)) * EACH
        reached = ((upto | TOP) - left * EACH) & TOP
        return 8 * word + 8 - np.bitwise_count(reached).astype(np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, characters before the middle, characters of the middle) of texts, for two whole numbers drawn for each."""
    words = as_words(data)
    going_on = Marks(continuations(words))
    ends = Marks(line_ends(words) if unit == "line" else char_ends(words))
    begin, end = offsets[:-1], offsets[1:]
    before = ends.rank(begin)
    closed = ends.rank(end) - before
    # What follows the last mark is a unit too.
    open_end = (end > begin) & (ends.rank(end) == ends.rank(np.maximum(end - 1, begin)))
    n = closed + open_end
    one, other = first % (n + 1), second % (n + 1)
    low, high = np.minimum(one, other), np.maximum(one, other)

    def place(k: np.ndarray) -> np.ndarray:
        out = np.where(k == n, end, begin)
        inner = (k > 0) & (k < n)
        out[inner] = ends.select((before + k)[inner]) + 1
        return out

    chars = lambda a, b: b - a - (going_on.rank(b) - going_on.rank(a))
    left, right = place(low), place(high)
    return n, chars(begin, left), chars(left, right)


def _cut(unit: str):
    @F.arrow_udf("struct<n:bigint,prefix:bigint,middle:bigint>")
    def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        one, other, out = first.to_numpy(), second.to_numpy(), [np.zeros((3, 0), np.int64)]
        for i, j, data, offsets in sliced(texts):
            out.append(np.array(cuts(data, offsets, one[i:j], other[i:j], unit)))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(out, axis=1)], ["n", "prefix", "middle"])

    return cut


def drawn(digest: Column, i: int) -> Column:
    """The i-th group of 8 hexadecimal digits, counted from 0, as a whole number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_units``, ``form``, ``fim_text``, ``prefix_chars`` and ``middle_chars``, replacing columns of these names.

    A text is cut after two whole numbers of units, ``line`` or ``char``, that its id and ``seed`` draw. In the form ``psm`` the text is prefix, suffix and
    middle, in ``spm`` suffix, prefix and middle, each after its sentinel. A text that is empty, holds a sentinel or isn't drawn
    by ``fim_percent`` is ``plain``: as it is, without numbers of characters. A null text counts as empty, a null id as no digits, so rows with one id and
    one text have one result. No rows give no rows; other columns keep their values, whatever their names.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    added = ("n_units", "form", "fim_text", "prefix_chars", "middle_chars")
    kept = [c for c in docs.columns if c not in added]
    # The text is read from ``t``, unless the cast to it has changed it.
    rest = [c for c in kept if c != text_col or docs.schema[c].dataType.simpleString() != "string"]
    whole = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None)
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(whole.alias("row"), F.col(f"`{text_col}`").cast("string").alias("t"), F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), key), "UTF-8"), 256).alias("h"))
    rows = rows.withColumns({f"h{i}": drawn(F.col("h"), i) for i in range(4)}).withColumn("cut", _cut(unit)("t", "h0", "h1"))
    whole_text = F.coalesce(F.col("t"), F.lit(""))
    plain = whole_text == ""
    for mark in sentinels:
        plain = plain | F.contains(whole_text, F.lit(mark))
    form = F.when(plain | (F.col("h2") % 100 >= fim_percent), "plain").when(F.col("h3") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("row", "t", "cut", form.alias("form"))
    at, n = F.col("cut.prefix").cast("int"), F.col("cut.middle").cast("int")
    prefix, middle = F.substring(whole_text, F.lit(1), at), F.substring(whole_text, at + 1, n)
    suffix = F.substring(whole_text, at + n + 1, F.length(whole_text))
    p, s, m = (F.lit(x) for x in sentinels)
    made = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(whole_text)
    cut_only = lambda c: F.when(F.col("form") != "plain", F.col(f"cut.{c}"))
    return rows.select(*[(F.col("row")[c] if c in rest else F.col("t")).alias(c) for c in kept], F.col("cut.n").alias("n_units"), "form", made.alias("fim_text"), cut_only("prefix").alias("prefix_chars"), cut_only("middle").alias("middle_chars"))


def restored(fim_text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that :func:`fill_in_middle` made ``fim_text`` of, read from it and its form alone."""
    parts = F.split(fim_text, "|".join(re.escape(x) for x in sentinels), -1)
    part = lambda i: F.get(parts, i)
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(fim_text)
