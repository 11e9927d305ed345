"""Conversations as prefix trees: turns that conversations begin with alike are written once, depth-first, with the attention that keeps them apart.

Each conversation is a path of turns, and each turn is named by a digest of all up to it. Equal paths are one; paths in the order of
their digests are the leaves of all trees, depth-first, and each different name is a segment that the first path to come along it writes. A running sum of lengths
over that order says where segments begin. A segment's tokens, which are code points here, have the positions that they have in each conversation that
holds them, and attend to the runs of segments that its ancestors are.

No tree is ever in one place: names meet their paths by joins on stored tables, which Spark splits where very many conversations begin alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import Scope
from tidelog.operators.ids import numbered, running_sums

#: Bytes of a turn's name.
NAME = 16
PATHS_SCHEMA = "row long, conv long, key binary, segments array<struct<text:string,size:int,loss_from:int,loss_to:int>>"
TREE_SCHEMA = "tree long, start long, end long, depth int, position long, ancestors array<struct<start:bigint,end:bigint>>, loss_from int, loss_to int, text string"


@dataclass(frozen=True)
class Template:
    """How a turn is written: ``open``, the role, a line feed, the text, ``close``, a line feed. Within roles and texts ``escape`` stands before what could be read as one of these."""

    open: str = "<turn>"
    close: str = "</turn>"
    escape: str = "\\"

    def escaped(self, text: Column, *more: str) -> Column:
        for mark in (self.escape, self.open, self.close, *more):
            text = F.replace(text, F.lit(mark), F.lit(self.escape + mark))
        return text

    def segment(self, role: Column, text: Column) -> Column:
        """A turn as written, with the places between which an assistant's text is in it."""
        head = F.concat(F.lit(self.open), self.escaped(role, "\n"), F.lit("\n"))
        body = self.escaped(text)
        learnt = lambda c: F.when(role == "assistant", c)
        whole = F.concat(head, body, F.lit(self.close + "\n"))
        return F.struct(whole.alias("text"), F.length(whole).alias("size"), learnt(F.length(head)).alias("loss_from"), learnt(F.length(head) + F.length(body)).alias("loss_to"))

    def plain(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(?s:(.))", r"\1", text)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn, read from what was written."""
        marks = re.compile("|".join([re.escape(self.escape) + "(?s:.)", re.escape(self.open), re.escape(self.close) + "\n", "\n"]))
        out, at, role = [], 0, None
        for m in marks.finditer(formatted):
            if m[0] == self.open:
                at, role = m.end(), None
            elif m[0] == "\n" and role is None:
                role, at = formatted[at : m.start()], m.end()
            elif m[0] == self.close + "\n":
                out.append((self.plain(role), self.plain(formatted[at : m.start()])))
                at, role = m.end(), None
        return out


def _paths(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, template: Template) -> DataFrame:
    """A row for each conversation: its segments, and the names of its turns, one after another, as ``key``."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    grouped = conversations.groupBy(F.col(f"`{conv_col}`").cast("long").alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = grouped.select(F.monotonically_increasing_id().alias("row"), "conv", F.transform("turns", lambda t: template.segment(t["role"], t["text"])).alias("segments"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column("segments")
            texts, keys, at = segments.flatten().field("text").to_pylist(), [], 0
            for n in segments.value_lengths().to_pylist():
                name, key = b"", []
                for text in texts[at : at + n]:
                    name = hashlib.blake2b(name + text.encode(), digest_size=NAME).digest()
                    key.append(name)
                keys.append(b"".join(key))
                at += n
            yield pa.record_batch({"row": batch.column("row"), "conv": batch.column("conv"), "key": pa.array(keys, pa.binary()), "segments": segments})

    return written.mapInArrow(named, PATHS_SCHEMA)


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[list[dict[str, int]], np.ndarray]:
    """The runs of segments that follow each other, and the number of each segment's run."""
    apart = np.concatenate([[False], starts[1:] != ends[:-1]])
    first = np.flatnonzero(np.concatenate([[True], apart[1:]]))
    last = np.append(first[1:], len(starts)) - 1
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[first], ends[last])], np.cumsum(apart)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each path, the segments that it is the first to come along, with all that is known of them."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("tree", "start", "end", "depth", "position", "ancestors", "loss_from", "loss_to", "text")}
        for path, new, segments in zip(batch.column("path").to_pylist(), batch.column("new").to_pylist(), batch.column("segments").to_pylist()):
            starts, sizes = np.array(path, np.int64), np.array([s["size"] for s in segments], np.int64)
            ends, position = starts + sizes, np.cumsum(sizes) - sizes
            runs, number = _runs(starts, ends)
            for d in range(len(path) - new, len(path)):
                before = runs[: number[d] + 1]
                # The run that the segment itself is in ends where it begins.
                before = [*before[:-1], {"start": before[-1]["start"], "end": int(starts[d])}] if before[-1]["start"] < starts[d] else before[:-1]
                row = (path[0], int(starts[d]), int(ends[d]), d + 1, int(position[d]), before, segments[d]["loss_from"], segments[d]["loss_to"], segments[d]["text"])
                for c, x in zip(out, row):
                    out[c].append(x)
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pair), pa.int32(), pa.int32(), pa.string())
        yield pa.record_batch({c: pa.array(out[c], t) for c, t in zip(out, types)})


def chat_trees(conversations: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scope: Scope | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trees of conversations: ``segments``, ``leaves`` and ``paths``, all stored.

    ``segments(tree, start, end, depth, position, ancestors, loss_from, loss_to, text)`` has each turn that different conversations begin alike with up to it
    once, at its place ``start`` to ``end`` in the depth-first order of all trees; ``tree`` is where its tree begins. Its tokens have positions from ``position`` on;
    a token attends to ``ancestors``, the places of what comes before the turn, and to what is before it in its own segment. From ``loss_from`` to ``loss_to``
    the segment is an assistant's text, which is to be learnt; null for others. ``leaves(conv, leaf)`` names the path of each conversation by the place where its last turn begins,
    and ``paths(leaf, path)`` has the places of its turns.

    Turns go by ``turn_col``, nulls first, equal ones by role and then by text; repeated rows are turns of their own. Null roles and texts are empty. Rows without
    a conversation's id, an integer, are one conversation. A conversation is held by a task as a whole, a tree never is. No rows give no rows; other columns are left out.
    """
    scope = Scope.of(scope, conversations)
    all_ = scope.stored(_paths(conversations, conv_col, turn_col, role_col, text_col, template), "conversations", free=True)
    sizes = F.col("segments.size").alias("sizes")
    classes = all_.groupBy("key").agg(F.min(F.struct("row", sizes)).alias("first")).select("key", "first.row", "first.sizes")
    ordered, _ = numbered(classes, ("key",), "leaf_number", scope.place("ordered"))
    ordered = scope.stored(ordered, "leaves_in_order")

    # A name belongs to the first path that has it. What is known of a name is stored before its paths meet it.
    depth = F.posexplode("sizes").alias("d", "size")
    steps = ordered.select("leaf_number", "key", depth).select("leaf_number", F.substring("key", F.col("d") * NAME + 1, F.lit(NAME)).alias("name"), "d", F.col("size").cast("long").alias("size"))
    steps = scope.stored(steps, "steps")
    names = steps.groupBy("name").agg(F.min("leaf_number").alias("leaf_number"), F.first("d").alias("d"), F.first("size").alias("size"))
    placed = scope.stored(running_sums(names, ("leaf_number", "d"), {"start": "size"}, scope.place("placed")), "names")
    along = steps.select("leaf_number", "name", "d").join(placed.select("name", "start", F.col("leaf_number").alias("writer")), "name")
    paths = along.groupBy("leaf_number").agg(F.sort_array(F.collect_list(F.struct("d", "start"))).alias("path"), F.count_if(F.col("writer") == F.col("leaf_number")).cast("int").alias("new"))
    paths = paths.select("leaf_number", F.col("path.start").alias("path"), "new").join(ordered.select("leaf_number", "row", "key"), "leaf_number")
    paths = scope.stored(paths, "paths")
    scope.drop(steps, placed, ordered)

    writers = paths.where("new > 0").select("row", "path", "new").join(all_.select("row", "segments"), "row")
    segments = scope.stored(writers.select("path", "new", "segments").mapInArrow(_segments, TREE_SCHEMA), "segments", free=True)
    leaf = F.element_at("path", -1).alias("leaf")
    leaves = scope.stored(all_.select("conv", "key").join(paths.select("key", leaf), "key").select("conv", "leaf"), "leaves")
    return segments, leaves, scope.stored(paths.select(leaf, "path"), "paths")


def read_back(segments: DataFrame, leaves: DataFrame, paths: DataFrame, template: Template = Template(), scope: Scope | None = None) -> DataFrame:
    """``(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of each conversation, from the segments along its path.

    The digest of turns is of role, line feed, text and line feed of each; that of the loss is of all text under the mask, as it was before escaping.
    """
    scope = Scope.of(scope, segments)

    @F.arrow_udf("struct<n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint>")
    def read(written: pa.Array, learnt: pa.Array) -> pa.Array:
        out = []
        for text, loss in zip(written.to_pylist(), learnt.to_pylist()):
            turns, loss = template.turns(text), template.plain(loss)
            digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
            out.append({"n_turns": len(turns), "turns_sha256": digest("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": digest(loss), "formatted_chars": len(text)})
        kinds = pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        return pa.array(out, kinds)

    loss = F.coalesce(F.substring("text", F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")), F.lit("")).alias("loss")
    steps = paths.select("leaf", F.explode("path").alias("start")).join(segments.select("start", "position", "text", loss), "start")
    whole = steps.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("position", "text", "loss"))).alias("x"))
    texts = whole.select("leaf", F.array_join("x.text", "").alias("text"), F.array_join("x.loss", "").alias("loss"))
    found = scope.stored(texts.select("leaf", read("text", "loss").alias("r")).select("leaf", "r.*"), "read", free=True)
    return leaves.join(found, "leaf").drop("leaf")
