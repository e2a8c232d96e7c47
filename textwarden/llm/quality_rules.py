"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are Spark columns. Small trees are grown on random halves of the labelled rows; each path from a root to
a node is a rule, a conjunction of thresholds. Rules and clipped linear terms get logistic weights under a lasso
penalty, by proximal gradient steps, and most weights become 0. What is left is compiled into one Spark column expression.

Training takes up to `sample` labelled rows, those of smallest hash; only their statistics reach the driver. Every
document is scored in full.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, fold_of

#: What an unlabelled world gets: no evidence either way.
NO_MODEL_SCORE = 0.5


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; null counts as empty. Shares are of characters, words or lines, 0 in an empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    words = F.array_remove(F.split(t, r"\s+"), "")
    many = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "upper": 1 - F.length(F.regexp_replace(t, r"\p{Lu}+", "")) / n,
        "symbols": without("#$%&*@^~<>{}[]=+_\\/"),
        "bangs": without("!?"),
        "bars": without("|"),
        "digits": without("0123456789"),
        "stops": without(".,;:"),
        "spaces": without(" \n\t"),
        "word_length": F.length(F.translate(t, " \n\t", "")) / many,
        "distinct_words": F.size(F.array_distinct(words)) / many,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_length": F.log1p(n / F.size(lines)),
        "doubled": (F.length(t) - F.length(F.regexp_replace(t, r"\b(\w+) \1\b", ""))) / n,
    }


#: The names of the statistics, in the order of their indices in rules.
NAMES = ["log_chars", "upper", "symbols", "bangs", "bars", "digits", "stops", "spaces", "word_length", "distinct_words", "distinct_lines", "line_length", "doubled"]


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + sum of weights of the rules that hold + sum of slope * clip(statistic))."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]
    linear: tuple[tuple[float, int, float, float], ...]

    def column(self, statistic: dict[str, Column]) -> Column:
        def holds(rule) -> Column:
            return reduce(lambda a, b: a & b, (statistic[NAMES[k]] <= t if low else statistic[NAMES[k]] > t for k, low, t in rule))

        terms = [F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0)) for w, rule in self.rules]
        terms += [F.lit(w) * F.least(F.greatest(statistic[NAMES[k]], F.lit(a)), F.lit(b)) for w, k, a, b in self.linear]
        total = reduce(lambda a, b: a + b, terms, F.lit(self.bias))
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, depth: int, least: int, chosen: np.random.Generator) -> list[tuple]:
    """Rules of one tree: the path to every node, by splits of the least squared error among random features and quantiles."""
    found: list[tuple] = []

    def grow(rows: np.ndarray, path: tuple, deep: int) -> None:
        if path:
            found.append(path)
        own = y[rows]
        if deep == depth or len(rows) < 2 * least or own.min() == own.max():
            return
        best = (0.0, None)
        for k in chosen.choice(x.shape[1], size=min(x.shape[1], 6), replace=False):
            for t in np.unique(np.quantile(x[rows, k], np.linspace(0.02, 0.98, 25))):
                low = x[rows, k] <= t
                n = int(low.sum())
                if least <= n <= len(rows) - least:
                    a, b = own[low].mean(), own[~low].mean()
                    gain = n * (len(rows) - n) / len(rows) * (a - b) ** 2
                    if gain > best[0] + 1e-12:
                        best = (gain, (int(k), float(t)))
        if best[1]:
            k, t = best[1]
            low = x[rows, k] <= t
            grow(rows[low], (*path, (k, True, t)), deep + 1)
            grow(rows[~low], (*path, (k, False, t)), deep + 1)

    grow(np.arange(len(y)), (), 0)
    return found


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty (FISTA); classes weigh as they occur."""
    n, m = z.shape
    w, bias = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, vb, t = w.copy(), bias, 1.0
    size = np.linalg.norm(np.column_stack((z, np.ones(n))), 2) ** 2 / (4 * n)
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(z @ v + vb, -50, 50))) - y
        new = v - z.T @ off / n / size
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / size, 0)
        new_bias = vb - off.mean() / size
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    return bias, w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 1e-3, steps: int = 400, seed: int = 7) -> Model:
    """A model of the statistics x (rows by NAMES) and labels y in {0, 1}. With one class only, a constant."""
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else (4.0 if y.min() else -4.0), (), ())
    chosen = np.random.Generator(np.random.PCG64(seed))
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        rows = chosen.choice(len(y), size=max(2, len(y) // 2), replace=False)
        for path in _paths(x[rows], y[rows], depth, max(2, len(y) // 400), chosen):
            rules.setdefault(path)
    kept = list(rules)
    holds = np.ones((len(y), len(kept)))
    for j, path in enumerate(kept):
        for k, low, t in path:
            holds[:, j] *= x[:, k] <= t if low else x[:, k] > t
    a, b = np.quantile(x, [0.02, 0.98], axis=0)
    clipped = np.clip(x, a, b)
    scale = np.maximum(clipped.std(0), 1e-9) / 0.4
    bias, w = _lasso(np.column_stack((holds, (clipped - clipped.mean(0)) / scale)), y, penalty, steps)
    linear = [(float(w[len(kept) + k] / scale[k]), k, float(a[k]), float(b[k])) for k in range(x.shape[1]) if abs(w[len(kept) + k]) > 1e-6]
    bias -= sum(s * clipped[:, k].mean() for s, k, _, _ in linear)
    return Model(float(bias), tuple((float(v), path) for v, path in zip(w, kept, strict=False) if abs(v) > 1e-6), tuple(linear))


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id and the statistics of each whole text, one row per row."""
    return docs.select("doc_id", *(c.alias(name) for name, c in statistics(F.col("text")).items()))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = 8000) -> Model:
    """A model from up to sample labelled rows whose crc32 of doc_id modulo folds is not held.

    Labels (doc_id, quality) whose doc_id or quality is null are ignored; a doc_id with several labels teaches their rounded mean.
    """
    fold = fold_of(F.col("doc_id"), folds)
    told = labels.where(F.col("quality").isNotNull() & (fold != held)).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    chosen = cut(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = measured(docs.join(checked_broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", *NAMES])
    return fit(rows[NAMES].to_numpy(dtype=float), rows["quality"].to_numpy(dtype=float))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = 8000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher: good), predicted (1 if score >= 0.5).

    Null and empty texts are scored by their statistics, which are those of the empty text. A null doc_id is held out. Without labels every
    score is NO_MODEL_SCORE. Repeated rows get a row each; other columns are ignored.
    """
    model = train(docs, labels, folds, held, sample)
    score = model.column({name: F.col(name) for name in NAMES})
    held_out = F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(True))
    return measured(docs).select("doc_id", held_out.alias("held_out"), score.alias("score")).select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject. The score belongs to the text alone, so equal texts share a fate."""
    model = train(docs, labels)
    # The rules refer to the lambda's variable, so that the statistics stand in the filter once, however far it is pushed down.
    measured_once = F.array(F.struct(*(c.alias(name) for name, c in statistics(F.col("text")).items())))
    score = F.get(F.transform(measured_once, lambda s: model.column({name: s[name] for name in NAMES})), 0)
    return docs.where(score >= 0.5)
