"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are runs of 2 to 4 bytes within a word, its edges included, hashed into buckets. A text is the mean of its
buckets' embeddings. Both layers are linear, so a trained model is one row of scores per bucket, and scoring a text is the mean
of the rows of its subwords. Training runs on the driver, in numpy, on a bounded sample of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.words import sliced
from tidelog.names import unused

BUCKET_BITS = 15
SIZES = (2, 3, 4)
#: Bytes that subwords are drawn from at once.
SLICE = 1 << 19


def _fold() -> np.ndarray:
    """Lower case for A-Z; every other ASCII byte that is no letter is an edge of a word."""
    out = np.arange(256, dtype=np.uint32)
    out[65:91] += 32
    for b in range(128):
        if not (97 <= out[b] <= 122):
            out[b] = 32
    return out


FOLD = _fold()


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text's number) of the subwords of each size, texts in order."""
    # An edge before and after each text keeps subwords from crossing from one to the next.
    at = offsets + np.arange(len(offsets)) + 0
    stream = np.full(len(data) + len(offsets), 32, np.uint32)
    inside = np.ones(len(stream), bool)
    inside[at] = False
    stream[inside] = FOLD[data]
    edge = stream == 32
    text = np.cumsum(~inside) - 1
    code = stream.copy()
    for n in range(2, max(SIZES) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ stream[n - 1 :]
        if n in SIZES:
            whole = ~(edge[: len(code)] & edge[n - 1 :])
            for k in range(1, n - 1):
                whole &= ~edge[k : k + len(code)]
            h = (code[whole] ^ (code[whole] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
            # Text k's leading edge is at at[k]; what starts there is text k's.
            yield (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), text[: len(code)][whole]


@dataclass(frozen=True)
class LanguageModel:
    """``table[bucket]`` has a score per language; ``bias`` is added to the mean; ``temperature`` and ``least`` are calibrated."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for buckets, text in subwords(data, offsets):
            count += np.bincount(text, minlength=n)[:n]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(text, weights=self.table[buckets, k], minlength=n)[:n]
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        return _softmax(scores / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 12, epochs: int = 8, rate: float = 0.5, precision: float = 0.98, most_lost: float = 0.01, seed: int = 5) -> LanguageModel | None:
    """Fit on ``(language, buckets, counts)``; every fifth example is held back to calibrate. No examples give no model.

    The temperature minimises the log loss of the examples held back; ``least`` is the lowest confidence at which those accepted
    are right at ``precision`` or better, but no higher than rejects a share of ``most_lost`` of those that are right: a wrong label counts as
    an error at any confidence, and no threshold makes up for it.
    """
    if not examples:
        return None
    rng = np.random.default_rng(seed)
    languages = tuple(sorted({x[0] for x in examples}))
    number = {x: i for i, x in enumerate(languages)}
    examples = [examples[i] for i in rng.permutation(len(examples))]
    held, fit = examples[::5], [x for i, x in enumerate(examples) if i % 5] or examples
    embed = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim))
    weights, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    step, steps = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            language, buckets, counts = fit[i]
            share = counts / max(1, counts.sum())
            mean = share @ embed[buckets]
            error = _softmax(mean @ weights + bias)
            error[number[language]] -= 1
            now = rate * (1 - step / steps)
            back = weights @ error
            weights -= now * np.outer(mean, error)
            bias -= now * 0.1 * error
            # The mean's gradient is shared out by count; scaled so that rare subwords move in a few epochs too.
            embed[buckets] -= now * np.minimum(1.0, share * 50)[:, None] * back
            step += 1
    table = (embed @ weights).astype(np.float32)
    logits = np.array([(c / max(1, c.sum())) @ table[b] + bias for _, b, c in held])
    truth = np.array([number[x[0]] for x in held])
    loss = lambda t: -np.mean(np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12))
    temperature = float(min(np.geomspace(0.05, 5, 40), key=loss))
    p = _softmax(logits / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    correct = p.argmax(axis=1) == truth
    right = np.cumsum(correct[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    least = 1 / len(languages) if len(good) == len(order) or right[-1] >= precision else (float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0)
    kept = np.sort(p.max(axis=1)[correct])
    if len(kept):
        least = min(least, float(kept[int(most_lost * len(kept))]))
    return LanguageModel(languages, table, bias, temperature, least)


def training_examples(docs: DataFrame, usable: Column, rows: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """At most ``rows`` documents with ``usable`` and a language, in equal parts of each language as far as it has them, by a hash of the id."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull())
    counts = dict(labelled.groupBy(F.col(lang_col)).count().orderBy(F.desc("count"), lang_col).limit(rows).collect())
    if not counts:
        return []
    each = max(1, rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))]), F.col(lang_col))
    sample = labelled.where(draw < share).orderBy(draw, id_col).limit(rows).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in sliced(batch.column("text"), SLICE):
                parts = list(subwords(data, offsets))
                buckets, text = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
                order = np.argsort(text, kind="stable")
                at = np.searchsorted(text[order], np.arange(len(offsets)))
                for i, j in zip(at, at[1:]):
                    out.append(np.unique(buckets[order[i:j]], return_counts=True))
            yield pa.record_batch({"lang": batch.column("lang"), "buckets": pa.array([b.astype(np.int32).tobytes() for b, _ in out], pa.binary()), "counts": pa.array([c.astype(np.int32).tobytes() for _, c in out], pa.binary())})

    found = sample.mapInArrow(features, "lang string, buckets binary, counts binary").collect()
    found.sort(key=lambda x: (x[0], bytes(x[1]), bytes(x[2])))
    return [(x[0], np.frombuffer(x[1], np.int32), np.frombuffer(x[2], np.int32).astype(float)) for x in found]


def fit_language_model(docs: DataFrame, usable: Column, rows: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> LanguageModel | None:
    """A model from a sample of at most ``rows`` labelled documents; whole texts are read. None if there are none."""
    return train(training_examples(docs, usable, rows, id_col, text_col, lang_col), **options)


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``, replacing columns of these names.

    ``score`` is the calibrated probability of ``lang_pred``. A text that is null or has no letter gets ``und``, score 0 and is rejected, as is every
    text without a model; others are rejected if the score is below the model's least. Ties go to the language first by code point. Rows are
    kept as they are, repeated or not.
    """
    added = ["lang_pred", "score", "rejected"]
    columns = [c for c in docs.columns if c not in added]
    letter = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    content, has_letter = unused(columns, "content", "has_letter")
    plain = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias(content), letter.alias(has_letter))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, letters = [], [], batch.column(has_letter).to_pylist()
            for _, _, data, offsets in sliced(batch.column(content), SLICE) if model else ():
                p = model.probabilities(model.scores(data, offsets))
                best = p.argmax(axis=1)
                names += [model.languages[k] for k in best.tolist()]
                scores += p[np.arange(len(best)), best].tolist()
            known = [bool(x and model) for x in letters]
            names = [x if k else "und" for k, x in zip(known, names or letters)]
            scores = [x if k else 0.0 for k, x in zip(known, scores or letters)]
            rejected = [not k or x < model.least for k, x in zip(known, scores)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*columns, *added])

    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])
    return plain.mapInArrow(predicted, schema)
