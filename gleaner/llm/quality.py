"""Quality scores by a sparse rule ensemble over text statistics.

Statistics of whole texts are Spark columns. Shallow boosted trees are fitted to labelled rows; every path from a root
to a node is a rule, a conjunction of comparisons. A logistic model with an L1 penalty over these rules keeps a few of
them, and they are compiled into one Spark expression, so that scoring runs inside the scan.

Defined cases: null text counts as empty and gets a score like any other; without labels of both kinds the score is
the share of label 1 (0.5 without labels); of repeated labels of a document the largest counts; repeated documents
are scored alike; of equally good splits the first statistic and the least threshold hold; statistics are of whole
texts, however long; an empty table gives an empty result; extra columns stay out of `score`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import let

#: Labelled rows to fit on at most, chosen by a hash of the id: a bounded sample.
TRAIN_ROWS = 12_000
TREES, DEPTH, RATE, BINS, LEAST = 24, 3, 0.3, 32, 8
#: Weight of the L1 penalty, for the mean loss.
PENALTY = 2e-4
THRESHOLD = 0.3

FEATURES = (
    "chars", "words", "word_len", "distinct_words", "repeated_neighbours", "lines", "distinct_lines", "line_len",
    "upper", "digits", "symbols", "pipes", "exclamations", "commas", "stops",
)


def statistics(text: Column) -> Column:
    """struct of FEATURES; shares are of the text's code points, words or lines."""
    text = F.coalesce(text, F.lit(""))

    def count(t: Column, what: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(what), F.lit("")))

    def without(t: Column, pattern: str) -> Column:
        return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

    def describe(x: Column) -> Column:
        t, words, lines = x["t"], x["w"], x["l"]
        n, w, k = F.greatest(F.length(t), F.lit(1)).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double")
        same = F.size(F.filter(words, lambda v, i: (i > 0) & (v == words[F.greatest(i - 1, F.lit(0))])))
        made = {
            "chars": F.length(t), "words": w, "word_len": F.length(t) / w, "distinct_words": F.size(F.array_distinct(words)) / w,
            "repeated_neighbours": same / w, "lines": k, "distinct_lines": F.size(F.array_distinct(lines)) / k, "line_len": F.length(t) / k,
            "upper": without(t, "[A-ZÀ-Þ]+") / n, "digits": without(t, "[0-9]+") / n, "symbols": without(t, "[#$%&*<>{}@^~_=+\\\\/\\[\\]]+") / n,
            "pipes": count(t, "|") / n, "exclamations": count(t, "!") / n, "commas": count(t, ",") / n, "stops": count(t, ".") / n,
        }
        return F.struct(*[made[f].cast("double").alias(f) for f in FEATURES])

    return let(F.struct(text.alias("t"), F.split(text, " ", -1).alias("w"), F.split(text, "\n", -1).alias("l")), describe)


def _tree(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, slope: np.ndarray, bend: np.ndarray, rows: np.ndarray, path: tuple, out: list, values: np.ndarray) -> None:
    """Grow one node by second-order gain over bin borders; every node but the root leaves its path in `out`."""
    if path:
        out.append(path)
    best = None
    if len(path) < DEPTH and len(rows) >= 2 * LEAST:
        g, h = slope[rows].sum(), bend[rows].sum()
        for f in range(x.shape[1]):
            b = binned[rows, f]
            n = len(edges[f]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, v, n))[:-1] for v in (slope[rows], bend[rows], np.ones(len(rows))))
            if not len(gl):
                continue
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
            k = int(np.argmax(gain))
            if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k)
    if best is None:
        values[rows] = -RATE * slope[rows].sum() / (bend[rows].sum() + 1)
        return
    _, f, k = best
    left = binned[rows, f] <= k
    for side, part in (("<=", rows[left]), (">", rows[~left])):
        _tree(x, edges, binned, slope, bend, part, (*path, (f, side, float(edges[f][k]))), out, values)


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, side, t in rule:
        out &= (x[:, f] <= t) if side == "<=" else (x[:, f] > t)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept and weighted rules; a rule is a tuple of (feature, '<=' or '>', threshold)."""
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        return float(np.log(p / (1 - p))), []
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    raw, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p, values = 1 / (1 + np.exp(-raw)), np.zeros(len(y))
        _tree(x, edges, binned, p - y, p * (1 - p), np.arange(len(y)), (), paths, values)
        raw += values
    rules, columns, seen = [], [], set()
    for rule in dict.fromkeys(paths):
        c = _holds(x, rule)
        if 0 < c.sum() < len(c) and (key := c.tobytes()) not in seen:  # rules that hold on the same rows are one
            seen.add(key)
            rules.append(rule)
            columns.append(c)
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    a = np.stack(columns, 1).astype(np.float64)
    # accelerated proximal gradient for mean logistic loss + PENALTY * |w|
    step = 4 * len(y) / np.linalg.norm(np.c_[a, np.ones(len(y))], 2) ** 2
    w, b = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(600):
        r = (1 / (1 + np.exp(-(a @ v + vb))) - y) / len(y)
        new, nb = v - step * (a.T @ r), vb - step * r.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return b, [(rule, float(c)) for rule, c in zip(rules, w, strict=True) if abs(c) > 1e-6]


def compiled(model: tuple[float, list[tuple[tuple, float]]], stats: Column) -> Column:
    """The model as a Spark expression over a struct of statistics."""
    total = F.lit(float(model[0]))
    for rule, weight in model[1]:
        holds = None
        for f, side, t in rule:
            one = stats[FEATURES[f]] <= F.lit(t) if side == "<=" else stats[FEATURES[f]] > F.lit(t)
            holds = one if holds is None else holds & one
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS):
    """Fit on at most `rows` labelled documents; their ids are broadcast (bounded), their statistics collected (bounded)."""
    chosen = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(rows)
    found = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__id")).select(statistics(F.col(text_col)).alias("__stats"), "__y", F.xxhash64("__id").alias("__h"))
    data = np.array([[*r[0], r[1], r[2]] for r in found.collect()], dtype=np.float64).reshape(-1, len(FEATURES) + 2)
    data = data[np.lexsort(data.T)]  # in an order of its own, so that reruns agree
    return fit(data[:, : len(FEATURES)], data[:, len(FEATURES)])


def score(docs: DataFrame, model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """`keep`, score double and predicted int (1 if the score reaches the threshold) for each row, in one pass."""
    with_stats = docs.select(*keep, statistics(F.col(text_col)).alias("__stats"))
    scored = with_stats.select(*keep, let(F.col("__stats"), lambda s: compiled(model, s)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with their columns."""
    marked = docs.withColumn("__score", let(statistics(F.col(text_col)), lambda s: compiled(model, s)))
    return marked.filter(F.col("__score") >= threshold).drop("__score")
