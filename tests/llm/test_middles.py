"""Fill-in-the-middle against a plain version, and its marks of bytes against plain counting."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import middles

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s)."}


def rows():
    rng = random.Random(1)
    some = [(i, "".join(rng.choices("a\néx漢\U0001f600 \n", k=rng.randint(0, 60)))) for i in range(300)]
    return some + [(None, None), (1000, ""), (1001, "\n"), (1002, "a"), (1003, "\n\n"), (1004, "x<P>y"), (1005, "ab\n" * 300_000), (1006, "<<S\n>P>\n<"), (5, some[5][1])]


def plain_version(doc_id, text, unit, fim=100, spm=50):
    text, h = text or "", hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    units, draws = re.findall(UNITS[unit], text), [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(d % (len(units) + 1) for d in draws[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or any(x in text for x in middles.SENTINELS) or draws[2] % 100 >= fim else "spm" if draws[3] % 100 < spm else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return len(units), form, out, *((None, None) if form == "plain" else (len(p), len(m)))


@pytest.mark.parametrize(("unit", "fim", "spm"), [("line", 100, 50), ("char", 100, 50), ("line", 60, 0)])
def test_middles(spark, unit, fim, spm):
    given = rows()
    docs = spark.createDataFrame([(t, i, "kept", -1) for i, t in given], "text string, doc_id long, form string, `t` long").repartition(3)
    made = middles.fill_in_middle(docs, fim_percent=fim, spm_percent=spm, unit=unit)
    assert made.columns == ["text", "doc_id", "t", "n_units", "form", "fim_text", "prefix_chars", "middle_chars"]
    found = made.withColumn("back", middles.restored(F.col("fim_text"), F.col("form"))).collect()
    assert len(found) == len(given) and {(r["doc_id"], r["text"]) for r in found} == set(given) and all(r["back"] == (r["text"] or "") and r["t"] == -1 for r in found)
    assert all((r["n_units"], r["form"], r["fim_text"], r["prefix_chars"], r["middle_chars"]) == plain_version(r["doc_id"], r["text"], unit, fim, spm) for r in found)


def test_no_rows_and_other_types(spark):
    assert middles.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = middles.fill_in_middle(spark.createDataFrame([("k", 12)], "name string, body long"), id_col="name", text_col="body", unit="char").first()
    assert (row["body"], row["n_units"], sorted(row["fim_text"])) == (12, 2, sorted("<P><S><M>12"))
    with pytest.raises(ValueError, match="unit must be one of"):
        middles.fill_in_middle(spark.range(1), unit="word")


def test_marks_are_counted_and_found():
    data = np.random.default_rng(2).choice(np.array([10, 11, 0, 65, 0x8A, 0xC3, 0xFF], np.uint8), 997)
    marks = middles.Marks(middles.line_ends(middles.as_words(data)))
    at = np.flatnonzero(data == 10)
    assert marks.select(np.arange(1, len(at) + 1)).tolist() == at.tolist()
    assert marks.rank(np.arange(len(data) + 1)).tolist() == [0, *np.cumsum(data == 10).tolist()]
