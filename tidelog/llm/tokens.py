"""Token counts of whole texts under a tokenizer file.

Ordinary texts are encoded as they are: plain ones by a faster library with the ranks of the same file, others by the
file's own library. A huge text is encoded in overlapping chunks with offsets, and neighbouring chunks
are spliced where that is proven to change nothing: at a boundary between two pre-tokens that both chunks have in their overlap, far enough
from where the earlier one was cut off. The earlier chunk has it from a true start, so it is a boundary of the whole text; what follows it depends on
the text from there on alone. When no such boundary is found the overlap is widened, until a chunk holds the rest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk, of the first overlap, and of texts that are encoded in one call.
CHUNK_CHARS, OVERLAP_CHARS, CALL_CHARS = 32_768, 512, 1 << 20
#: Pre-tokens and characters before a cut that may be other than in the whole text: look-ahead, contractions, and parts of special strings.
UNSURE_PRETOKENS, UNSURE_CHARS = 4, 64
# Fixed value: how byte-level BPE splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


#: Texts of these characters are split and merged alike by both libraries, whatever tables of Unicode they were built with.
PLAIN = re.compile("[\t\n\r -~\u00c0-\u024f]*")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def plain_encoder(path: str):
    """A faster encoder of plain texts with the ranks of the same file, or None if the file isn't byte-level BPE whose ids follow its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if spec.get("normalizer") or spec.get("post_processor") or model.get("type") != "BPE" or any(model.get(x) for x in options):
        return None
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    if [model["vocab"].get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    letters = _bytes_of_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(pairs)}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    if any(x.get(k) for x in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def boundaries(encoding) -> tuple[np.ndarray, np.ndarray]:
    """(first character, number of tokens before) of each pre-token of an encoding."""
    words = encoding.word_ids
    starts = np.array([a for a, _ in encoding.offsets], np.int64)
    # Special tokens have no pre-token's number or their own; each change is a boundary.
    first = [i for i in range(len(words)) if i == 0 or words[i] != words[i - 1] or words[i] is None]
    return starts[first], np.array(first, np.int64)


def count_huge(text: str, encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of ``text``, spliced from chunks; ``encode`` gives an encoding with offsets."""
    total, start, size = 0, 0, chunk
    while True:
        end = min(len(text), start + size)
        here = encode(text[start:end])
        if end == len(text):
            return total + len(here.ids)
        at, before = boundaries(here)
        at = at + start
        sure = at[: max(0, len(at) - UNSURE_PRETOKENS)]
        sure = sure[(sure <= end - UNSURE_CHARS) & (sure > start)]
        splice, width = None, overlap
        while splice is None and width < end - start:
            # The next chunk starts wherever the overlap does, in the middle of a pre-token or not.
            probe_end = min(len(text), end + overlap)
            probe, _ = boundaries(encode(text[end - width : probe_end]))
            probe = probe[probe > 0] + end - width
            common = np.intersect1d(sure, probe)
            splice, width = (int(common[-1]) if len(common) else None), width * 2
        if splice is None:
            size *= 2
            continue
        total += int(before[np.searchsorted(at, splice)])
        start, size = splice, chunk


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row for each row of ``docs``; other columns are left out.

    The file is one of the tokenizers library; no special tokens are added, and special strings within texts are treated as the library
    does by default. A null text counts as empty: no bytes and no tokens. Null ids and repeated rows are returned as they are. No rows give no rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, plain = tokenizer(tokenizer_path), plain_encoder(tokenizer_path)

        def encode(text: str):
            return library.encode(text, add_special_tokens=False)

        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            counts = [0] * len(texts)
            call: list[int] = []
            held = 0
            for i, text in enumerate([*texts, None]):
                if call and (text is None or held + len(text) > CALL_CHARS):
                    for k, e in zip(call, library.encode_batch_fast([texts[k] for k in call], add_special_tokens=False)):
                        counts[k] = len(e)
                    call, held = [], 0
                if text and len(text) > 2 * chunk:
                    counts[i] = count_huge(text, encode, chunk, overlap)
                elif text and plain and PLAIN.fullmatch(text):
                    counts[i] = len(plain.encode(text, allowed_special="all"))
                elif text:
                    call.append(i)
                    held += len(text)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(counts, pa.int64())})

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return texts.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
