"""Plain versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(ids, sets, num=3, den=4):
    """The smallest id that each can reach by links."""
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    roots = [root(i) for i in range(len(ids))]
    best = {}
    for i, r in enumerate(roots):
        if ids[i] is not None and (r not in best or ids[i] < best[r]):
            best[r] = ids[i]
    return [best.get(r) for r in roots]


def removed(docs, window=20):
    """For (id, text) in order: kept words, and how many of each were removed."""
    seen, out = set(), []
    for _, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append(([x for k, x in enumerate(w) if k not in gone], len(gone)))
    return out


def targets(sizes, weights, most):
    """Targets by source: shares by weight, cut at most times the size, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        cut = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not cut:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in cut:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in cut)
        open_ -= set(cut)
    return out


def spots(text, anchors, chain=2):
    """SpotSigs signatures as tuples: an anchor and the content words after it; failing these the words, and failing these the text."""
    found = [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)) if w]
    content = [i for i, w in enumerate(found) if w not in anchors]
    out = set()
    for i, w in enumerate(found):
        after = [k for k in content if k > i][:chain]
        if w in anchors and len(after) == chain:
            out.add((w, *(found[k] for k in after)))
    return out or set(found) or ({text} if text else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def least_cost(lengths, permitted, cost):
    """The cost of the best packing of a few pieces."""

    def best(left, bins):
        if not left:
            return sum(cost(min(c for c in permitted if c >= b)) for b in bins)
        n, rest = left[0], left[1:]
        tries = [best(rest, bins[:i] + [b + n] + bins[i + 1 :]) for i, b in enumerate(bins) if b + n <= max(permitted)]
        return min([*tries, best(rest, [*bins, n])])

    return best(list(lengths), [])
