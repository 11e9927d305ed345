"""A quality classifier as a sparse ensemble of rules over statistics of a text.

Statistics are DataFrame expressions. On a bounded sample of labelled rows, small trees are grown, each path from a root becomes a
rule (a conjunction of comparisons), and a lasso logistic regression weighs rules and statistics. The few with a weight are compiled back into one
column expression, so scoring a corpus is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.names import unused

WORD = r"[^\x20\x09-\x0D]+"


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and a double for each statistic of the text; null counts as empty. No kept column has the name of a statistic."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    t, chars, words, upper, symbols, digits, stops, lines, parts = unused(keep, "content", "chars", "words", "upper", "symbols", "digits", "stops", "lines", "parts")
    base = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias(t)).withColumns(
        {
            chars: F.length(t),
            words: F.regexp_count(t, F.lit(WORD)),
            upper: F.regexp_count(t, F.lit(r"\p{Lu}")),
            symbols: F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]")),
            digits: F.regexp_count(t, F.lit(r"\p{N}")),
            stops: F.regexp_count(t, F.lit(r"[.!?]")),
            lines: F.split(t, "\n"),
            parts: F.split(t, " "),
        }
    )
    without = lambda x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    return base.select(
        *[F.col(f"`{c}`") for c in keep],
        F.log1p(words).alias("log_words"),
        _share(F.col(chars), F.col(words)).alias("chars_per_word"),
        _share(F.col(upper), F.col(chars)).alias("upper_share"),
        _share(F.col(symbols), F.col(words)).alias("symbols_per_word"),
        _share(F.col(digits), F.col(chars)).alias("digit_share"),
        _share(F.col(stops), F.col(words)).alias("stops_per_word"),
        _share(without(","), F.col(words)).alias("commas_per_word"),
        _share(without("|"), F.col(words)).alias("bars_per_word"),
        _share(F.size(lines), F.col(words)).alias("lines_per_word"),
        _share(F.size(F.array_distinct(lines)), F.size(lines)).alias("distinct_lines"),
        _share(F.size(F.array_distinct(parts)), F.size(parts)).alias("distinct_words"),
    )


STATISTICS = ("log_words", "chars_per_word", "upper_share", "symbols_per_word", "digit_share", "stops_per_word", "commas_per_word", "bars_per_word", "lines_per_word", "distinct_lines", "distinct_words")
#: A comparison: statistic's number, whether it is above, and the bound.
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """Weights of rules and of scaled statistics, and a bias, all on the log-odds of label 1."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    linear: tuple[tuple[int, float, float, float, float, float], ...]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 over the columns of :func:`statistics`."""
        terms = [F.lit(self.bias)]
        for conditions, weight in self.rules:
            hit = F.lit(True)
            for k, above, bound in conditions:
                c = F.col(STATISTICS[k])
                hit = hit & (c > bound if above else c <= bound)
            terms.append(F.when(hit, weight).otherwise(0.0))
        for k, low, high, mean, scale, weight in self.linear:
            terms.append((F.greatest(F.lit(low), F.least(F.lit(high), F.col(STATISTICS[k]))) - mean) / scale * weight)
        while len(terms) > 1:  # in pairs, so that the expression stays shallow
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]
        total = terms[0]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow_tree(x: np.ndarray, y: np.ndarray, rows: np.ndarray, bounds: list[np.ndarray], depth: int, least: int, rng: np.random.Generator, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """The paths of a regression tree on ``rows``: each split takes the best of the ``bounds`` of some statistics."""
    found = [path] if path else []
    if depth == 0 or len(rows) < 2 * least or y[rows].std() < 1e-6:
        return found
    best = (1e-9, -1, 0.0)
    total, n = y[rows].sum(), len(rows)
    for k in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]:
        v = x[rows, k]
        for bound in bounds[k]:
            low = v <= bound
            m = int(low.sum())
            if least <= m <= n - least:
                s = y[rows][low].sum()
                gain = s * s / m + (total - s) ** 2 / (n - m) - total * total / n
                if gain > best[0]:
                    best = (gain, int(k), float(bound))
    if best[1] < 0:
        return found
    _, k, bound = best
    low = x[rows, k] <= bound
    for side, above in ((low, False), (~low, True)):
        found += grow_tree(x, y, rows[side], bounds, depth - 1, least, rng, (*path, (k, above, bound)))
    return found


def _hits(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in conditions:
        out &= x[:, k] > bound if above else x[:, k] <= bound
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, strength: float, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias of L1-penalised logistic regression, by accelerated proximal gradient steps; the bias is free."""
    n = len(y)
    b = np.hstack([a, np.ones((n, 1))])
    v = np.ones(b.shape[1])
    for _ in range(20):
        v = b.T @ (b @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 * n / (np.linalg.norm(b @ v) ** 2 + 1e-9)
    w = z = np.zeros(b.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b @ z, -30, 30)))
        new = z - step * (b.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * strength)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 11) -> RuleModel:
    """Rules and weights for ``y`` (0 or 1) from the statistics ``x``; one label alone, or no rows, gives a constant.

    Trees fit what the trees before leave over, each on half of the rows; the lasso's strength is the greatest whose log loss on a fifth of
    the rows is about the least.
    """
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleModel((), (), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    rules: dict[tuple[Condition, ...], None] = {}
    # The same few bounds for all trees, so that trees agree on rules.
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 33))) for k in range(x.shape[1])]
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-f))
        rows = rng.choice(len(y), max(2, len(y) // 2), replace=False)
        for path in grow_tree(x, residual, rows, bounds, depth, max(5, len(y) // 400), rng):
            rules[path] = None
            if len(path) == depth:
                hit = _hits(x, path)
                if hit.any():
                    f[hit] += 0.3 * 4 * residual[hit].mean()
    paths = list(rules)
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    cut = np.clip(x, low, high)
    mean, scale = cut.mean(axis=0), cut.std(axis=0) / 0.4 + 1e-9
    a = np.hstack([np.stack([_hits(x, p) for p in paths], axis=1).astype(float) if paths else np.zeros((len(y), 0)), (cut - mean) / scale])
    test = rng.permutation(len(y)) % 5 == 0
    if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
        test = np.zeros(len(y), bool)

    def loss(strength: float) -> float:
        w, b = lasso_logistic(a[~test], y[~test], strength)
        p = 1 / (1 + np.exp(-np.clip(a[test] @ w + b, -30, 30)))
        return -np.mean(np.log(np.where(y[test] > 0, p, 1 - p) + 1e-9))

    strengths = (0.03, 0.01, 0.003, 0.001)
    losses = [loss(s) for s in strengths] if test.any() else [0.0, 0.0, 0.0, 0.0]
    strength = next(s for s, x in zip(strengths, losses) if x <= min(losses) * 1.15 + 0.005) if test.any() else 0.003
    w, b = lasso_logistic(a, y, strength)
    k = len(paths)
    return RuleModel(
        tuple((p, float(v)) for p, v in zip(paths, w[:k]) if abs(v) > 1e-4),
        tuple((i, float(low[i]), float(high[i]), float(mean[i]), float(scale[i]), float(v)) for i, v in enumerate(w[k:]) if abs(v) > 1e-4),
        b,
    )


def fit_quality_model(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """A model from at most ``rows`` labelled rows that are ``usable`` (a condition on ``doc_id``), taken by a hash of the id; whole texts are read."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & usable)
    sample = known.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "y").limit(rows)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    found = statistics(chosen, "text", ("doc_id", "y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y", *STATISTICS).limit(rows).toPandas()
    return fit_rules(found[list(STATISTICS)].to_numpy(float), found["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)``, one row for each row of ``docs``, repeated or not; a null text is scored as an empty one, null ids are kept."""
    scored = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
