"""Quality by a sparse ensemble of rules over text statistics, compiled into Spark column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

_SPACE = r"[ \t-\r]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by built-in functions alone; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    of = lambda part, whole: F.coalesce(part.cast("double") / F.greatest(whole, F.lit(1)), F.lit(0.0))
    kept = lambda what: F.length(F.regexp_replace(text, f"[^{what}]+", ""))
    words = F.filter(F.split(F.lower(text), _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    n, m = F.size(words), F.size(lines)
    again = F.regexp_count(text, F.lit(r"(?<![^ \n])([^ \n]+)(?= \1(?![^ \n]))"))
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "word_length": of(chars, n),
        "upper": of(kept(r"\p{Lu}"), chars),
        "symbols": of(kept(r"|#$%&*@=<>{}_~^+\\\[\]/"), n),
        "shouts": of(kept("!?"), n),
        "digits": of(kept("0-9"), chars),
        "stops": of(kept(".,;:"), n),
        "distinct_words": of(F.size(F.array_distinct(words)), n),
        "distinct_lines": of(F.size(F.array_distinct(lines)), m),
        "words_a_line": of(n, m),
        "words_again": of(again, n),
    }


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is above, threshold) that all hold, and the weight of that."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            c = F.col(f"s.{name}")
            out = out & ((c > F.lit(at)) if above else (c <= F.lit(at)))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.conditions:
            out &= (x[:, names.index(name)] > at) == above
        return out


@dataclass
class Ensemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """The score, over a struct column ``s`` of statistics."""
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def _tree(x: np.ndarray, g: np.ndarray, rows: np.ndarray, names: list[str], cuts: list[np.ndarray], depth: int, path: tuple, out: list, least: int) -> np.ndarray:
    """Grow a regression tree on residuals; every node but the root is a rule. Returns the leaves' means by row."""
    fitted = np.zeros(len(x))
    fitted[rows] = g[rows].mean()
    if depth == 0 or len(rows) < 2 * least:
        return fitted
    best, total = (1e-9, None), g[rows].sum()
    for j in range(x.shape[1]):
        bins = np.searchsorted(cuts[j], x[rows, j], "left")
        n = np.cumsum(np.bincount(bins, minlength=len(cuts[j]) + 1))[:-1]
        s = np.cumsum(np.bincount(bins, weights=g[rows], minlength=len(cuts[j]) + 1))[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s * s / n + (total - s) ** 2 / (len(rows) - n) - total**2 / len(rows)
        gain[(n < least) | (len(rows) - n < least)] = -1
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), (j, float(cuts[j][gain.argmax()])))
    if best[1] is None:
        return fitted
    j, at = best[1]
    above = x[rows, j] > at
    for side in (True, False):
        own = (*path, (names[j], side, at))
        out.append(own)
        part = _tree(x, g, rows[above == side], names, cuts, depth - 1, own, out, least)
        fitted[rows[above == side]] = part[rows[above == side]]
    return fitted


def _simplified(path: tuple) -> tuple:
    """A path with one bound for each statistic and side."""
    bound: dict = {}
    for name, above, at in path:
        bound[name, above] = max(bound.get((name, above), -math.inf), at) if above else min(bound.get((name, above), math.inf), at)
    return tuple(sorted((n, a, t) for (n, a), t in bound.items()))


def _lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an l1 penalty, by accelerated proximal gradient steps; the intercept is free."""
    z = np.column_stack([np.ones(len(z)), z]).astype(np.float64)
    w = weight / weight.sum()
    top = np.ones(z.shape[1])
    for _ in range(30):
        top = z.T @ (w * (z @ top))
        top /= np.linalg.norm(top)
    rate = 4 / max(float(top @ (z.T @ (w * (z @ top)))), 1e-9)
    b, v, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        new = v - rate * (z.T @ (w * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, b, t = new + (t - 1) / s * (new - b), new, s
    return float(b[0]), b[1:]


def _sparsest(z: np.ndarray, y: np.ndarray, penalties: tuple[float, ...], rng: np.random.Generator) -> float:
    """The largest penalty whose loss on rows left aside is within a standard error, or 0.003, of the smallest loss."""
    aside = rng.random(len(y)) < 0.25
    if not aside.any() or len(set(y[~aside].tolist())) < 2:
        return penalties[0]
    losses = []
    for penalty in penalties:
        intercept, weight = _lasso(z[~aside], y[~aside], np.ones(int((~aside).sum())), penalty)
        m = (z[aside] @ weight + intercept) * np.where(y[aside] > 0, -1, 1)
        losses.append(np.logaddexp(0, m))
    best = min(losses, key=lambda v: v.mean())
    limit = best.mean() + max(0.003, best.std() / math.sqrt(len(best)))
    return max(p for p, v in zip(penalties, losses) if v.mean() <= limit)


def learn(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, bins: int = 48, penalties: tuple[float, ...] = (3e-2, 1e-2, 3e-3, 1e-3, 3e-4), seed: int = 3) -> Ensemble:
    """Boosted small trees give the rules, the lasso keeps few of them: the largest of ``penalties`` that costs nothing
    measurable on rows left aside. One label only: a constant score."""
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    base = math.log(y.mean() / (1 - y.mean()))
    f, paths = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), max(2, len(y) // 2), replace=False))
        out: list = []
        fitted = _tree(x, y - p, rows, names, cuts, depth, (), out, max(3, len(y) // 500))
        f = f + np.clip(fitted / max(1e-3, float((p * (1 - p)).mean())), -2, 2) * 0.3
        paths += out
    rules = [Rule(c) for c in dict.fromkeys(map(_simplified, paths))]
    z = np.column_stack([r.holds(x, names) for r in rules]).astype(np.float64)
    mean = z.mean(0)
    scale = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)  # centred, or rules that nearly always hold stall the steps
    z = (z - mean) / scale
    intercept, weight = _lasso(z, y, np.ones(len(y)), _sparsest(z, y, penalties, rng))
    weight = weight / scale
    return Ensemble(float(intercept - weight @ mean), [Rule(r.conditions, float(w)) for r, w in zip(rules, weight) if w])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 7, **options) -> Ensemble:
    """An ensemble from labelled texts: docs (doc_id, text), labels (doc_id, quality). The ``sample`` documents of the
    smallest hashes of doc_id are learnt from, a bounded table that is sent to all tasks; only their statistics come to
    the driver. Of several labels or texts of one doc_id the smallest counts. Rows with a null id or label are left out."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("quality"))
    n = known.count()
    place = F.pmod(F.xxhash64(F.lit(seed), "of"), F.lit(1 << 30))
    low = known.filter(place < int(min(1.0, (1 + 8 / math.sqrt(sample)) * sample / max(n, 1)) * (1 << 30)))
    chosen = low.groupBy("of").agg(F.min("quality").alias("quality")).orderBy(place, "of").limit(sample)
    names = list(statistics(F.lit("")))
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    got = got.select("doc_id", "quality", F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()]).alias("s")).groupBy("doc_id", "quality").agg(F.min("s").alias("s"))
    rows = sorted(got.select("doc_id", "quality", "s.*").collect(), key=tuple)
    x = np.asarray([[r[k] for k in names] for r in rows], float).reshape(-1, len(names))
    return learn(x, np.asarray([r["quality"] for r in rows], float), names, **options)


def score(docs: DataFrame, ensemble: Ensemble, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted; any columns of these names are replaced. Whole texts are read; a null
    text counts as empty, an empty table gives an empty one, repeated rows stay."""
    clash = [c for c in docs.columns if c.lower() in ("s", "score", "predicted")]
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted", "s")]
    extra = [F.col(f"`{c}`").alias("__s") for c in clash if c.lower() == "s"]
    with_s = docs.select(*keep, *extra, F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()]).alias("s"))
    scored = with_s.withColumn("score", ensemble.column()).drop("s")
    scored = scored.withColumnRenamed("__s", "s") if extra else scored
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of all documents, learnt from labels of those that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ensemble = fit(docs, labels.filter(~held_out()))
    return score(docs.select("doc_id", "text"), ensemble).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", "predicted")
