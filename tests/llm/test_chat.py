"""Prefix trees of conversations: each shared turn once, what a token sees is its conversation's past, and all is read back as it was."""

import hashlib
import random

import pytest

from tidelog.llm import chat
from tidelog.llm.chat import Template

HARD = ["", None, "\\", "a</turn>\n<turn>assistant\nb", "\\</turn>", "line\nline\n", "\\\\<turn>", "é漢\U0001f600", "x" * 50_000]


def corpus():
    rng = random.Random(7)
    first = [("user", "hello"), ("system", "be kind"), ("user", "hello</turn>"), ("us\ner", "q"), (None, "r")]
    rows, c = [], 0
    for _ in range(120):
        turns = [first[0] if rng.random() < 0.5 else rng.choice(first)]
        turns += [(("assistant", "user")[k % 2], rng.choice(["yes", "no", rng.choice(HARD)])) for k in range(rng.randint(0, 5))]
        for _ in range(rng.choice([1, 1, 3])):
            rows += [(c, k if k else None, r, t) for k, (r, t) in enumerate(turns)]
            c += 1
    rows += [(None, 0, "user", "lost"), (None, 1, "assistant", "found"), (c, 2, "assistant", "tie"), (c, 2, "assistant", "a tie"), (c, 2, "assistant", "tie")]
    return rows + [(c + 1, k, "assistant", f"turn {k}") for k in range(500)]


def conversations(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


@pytest.mark.parametrize("template", [Template(), Template("[[", "]]", "~")])
def test_trees(spark, template):
    rows = corpus()
    given = spark.createDataFrame([(c, 1, t, r, k) for c, k, r, t in rows], "conv_id long, leaf long, text string, role string, turn long").repartition(4)
    segments, leaves, paths = chat.chat_trees(given, template)
    want = conversations(rows)

    found = {r["conv"]: r for r in chat.read_back(segments, leaves, paths, template).collect()}
    assert set(found) == set(want) and leaves.count() == len(want)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(found[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss))

    # Each different beginning is there once; places follow each other, and so do those of a tree.
    tree = sorted(segments.collect(), key=lambda r: r["start"])
    beginnings = {tuple(turns[:k]) for turns in want.values() for k in range(1, len(turns) + 1)}
    assert len(tree) == len(beginnings) and [r["start"] for r in tree] == [0, *[r["end"] for r in tree[:-1]]]
    assert all(len(r["text"]) == r["end"] - r["start"] for r in tree)
    assert len({r["tree"] for r in tree}) == len({b for b in beginnings if len(b) == 1}) and all(a["tree"] <= b["tree"] for a, b in zip(tree, tree[1:]))
    # A token sees what is before it in its conversation, and nothing else.
    stream = "".join(r["text"] for r in tree)
    past = {r["start"]: ("".join(stream[a["start"] : a["end"]] for a in r["ancestors"]), r) for r in tree}
    way = {r["leaf"]: r["path"] for r in paths.collect()}
    for leaf in {r["leaf"] for r in leaves.collect()}:
        so_far = ""
        for k, start in enumerate(way[leaf]):
            seen, r = past[start]
            assert (seen, r["position"], r["depth"]) == (so_far, len(so_far), k + 1)
            so_far += r["text"]
    assert max(len(r["ancestors"]) for r in tree if r["depth"] > 300) <= 2


def test_no_rows(spark):
    segments, leaves, paths = chat.chat_trees(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert chat.read_back(segments, leaves, paths).count() == 0 and segments.count() == 0
