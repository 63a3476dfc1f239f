"""Document quality by Bradley-Terry pairwise ranking.

Each labelled good document is set against a few bad ones; the probability
that the good one wins is the logistic of the difference of two linear
scores, so the weights come from logistic regression without intercept on
feature differences.  A quantile of the scores of all labelled training
documents, at the share that is labelled bad, is the threshold.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import held_out, save, training_rows, trim

FEATURES = ["log_words", "word_length", "distinct_words", "distinct_per_root", "adjacent_repeats", "upper", "shouted",
            "digits", "marks", "mark_ends", "lone_marks", "bars", "line_repeats", "sentence_ends", "short_text", "runs"]
_RUNS = re.compile(rb"([^\s\w])\1")


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text: counts and shares; an empty text has zeros and ``short_text``."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * 14 + [1.0, 0.0]
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw) - int(count[[9, 10, 11, 12, 13, 32]].sum()))
    upper, lower, digit = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    usual = int(count[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) - usual
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    ends = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    doubled = len(_RUNS.findall(raw))
    return [np.log1p(n), min(size / n, 30.0) / 10, distinct / n, distinct / n ** 0.7, sum(map(eq, words, words[1:])) / n,
            upper / max(1, upper + lower), min(1.0, upper / n / 4), digit / size, min(1.0, 10 * marks / size),
            min(1.0, doubled / n), min(1.0, raw.count(b"!!") / n), min(1.0, raw.count(b" | ") * 2 / n),
            1 - len(set(lines)) / max(1, len(lines)), min(1.0, 8 * ends / n), 1.0 if n < 8 else 0.0,
            min(1.0, (raw.count(b"***") + raw.count(b"###") + raw.count(b"$$$") + raw.count(b"&&&") + raw.count(b"%%%")) / n)]


def feature_array(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def f(t: pd.Series) -> pd.Series:
        out = pd.Series([features(x) for x in t])
        trim()
        return out
    return f(text)


def preference_pairs(train: DataFrame, each: int = 3) -> DataFrame:
    """(good, bad) feature arrays: ``each`` partners for every row of the
    larger class, dealt by number, so pairs stay in proportion to rows."""
    from pyspark.sql import Window
    numbered = train.withColumn("i", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1)
    numbered = save(numbered, "bt-train")
    n = {r["y"]: r["n"] for r in numbered.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return numbered.limit(0).select(F.col("x").alias("good"), F.col("x").alias("bad"))
    large, small = (1, 0) if n[1] >= n[0] else (0, 1)
    # of row i of the larger class, partner k is row i*each+k of the smaller one, round and round
    a = numbered.where(f"y = {large}").select(F.col("x").alias("xa"), F.posexplode(F.array_repeat(F.lit(0), each)).alias("k", "z"), "i") \
        .select("xa", ((F.col("i") * each + F.col("k")) % n[small]).alias("j"))
    b = numbered.where(f"y = {small}").select(F.col("x").alias("xb"), F.col("i").alias("j"))
    pairs = a.join(b, "j")
    good, bad = ("xa", "xb") if large == 1 else ("xb", "xa")
    return pairs.select(F.col(good).alias("good"), F.col(bad).alias("bad"))


def fit(train: DataFrame, each: int = 3, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Bradley-Terry weights from ``train`` (doc_id, x, y): Newton steps whose
    gradient and curvature are summed over the pairs by Spark tasks.  One
    class alone gives zero weights."""
    pairs = save(preference_pairs(train, each), "bt-pairs")
    w = np.zeros(len(FEATURES))
    k = len(w)

    def sums(w):
        def task(batches):
            g, h, n = np.zeros(k), np.zeros((k, k)), 0
            for pdf in batches:
                if len(pdf):
                    d = np.stack(pdf["good"].to_numpy()) - np.stack(pdf["bad"].to_numpy())
                    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                    g, h, n = g + d.T @ (1 - p), h + (d * (p * (1 - p))[:, None]).T @ d, n + len(d)
            yield pd.DataFrame({"g": [g.tolist()], "h": [h.ravel().tolist()], "n": [n]})
        rows = pairs.mapInPandas(task, "g array<double>, h array<double>, n bigint").collect()  # one small row a task
        return (np.sum([r["g"] for r in rows], 0), np.sum([r["h"] for r in rows], 0).reshape(k, k), sum(r["n"] for r in rows)) \
            if rows else (np.zeros(k), np.zeros((k, k)), 0)

    for _ in range(steps):
        g, h, n = sums(w)
        if not n:
            break
        step = np.linalg.solve(h / n + ridge * np.eye(k), g / n - ridge * w)
        w = w + step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    return w


def raw_score(x: Column, weights: np.ndarray) -> Column:
    terms = F.zip_with(x, F.array(*[F.lit(float(v)) for v in weights]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def quantile_threshold(scored: DataFrame, grid: int = 400) -> float:
    """The quantile of all scores (raw, y) that parts the labels with the
    fewest errors, halfway to the next score grid point."""
    steps = [i / grid for i in range(grid + 1)]
    cuts = sorted(set(scored.agg(F.percentile_approx("raw", steps, 20_000)).first()[0] or []))
    if len(cuts) < 2:
        return cuts[0] if cuts else 0.0
    between = [(a + b) / 2 for a, b in zip(cuts, cuts[1:])]
    # rows of each class in each gap between neighbouring cuts: a few hundred rows
    counts = scored.groupBy(F.expr(f"array_size(filter(array({', '.join(f'{c!r}D' for c in between)}), c -> c <= raw))").alias("gap")) \
        .agg(F.sum(F.expr("int(y = 1)")).alias("good"), F.sum(F.expr("int(y = 0)")).alias("bad")).collect()
    good, bad = np.zeros(len(cuts)), np.zeros(len(cuts))
    for r in counts:
        good[r["gap"]], bad[r["gap"]] = r["good"], r["bad"]
    errors = np.cumsum(good)[:-1] + bad.sum() - np.cumsum(bad)[:-1]
    best = np.flatnonzero(errors == errors.min())
    return between[int(best[len(best) // 2])]


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, each: int = 3) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with ``_held_out`` and
    ``_score`` (which replace columns of those names): see ``score``."""
    return docs.withColumn("_held_out", held_out()).withColumn("_score", score(docs, labels, train_rows, each))


def score(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, each: int = 3) -> Column:
    """Quality of every whole text, 0 to 1, 0.5 at the threshold, as a column of ``docs`` (doc_id, text, ...).

    The weights are fitted on at most ``train_rows`` labelled rows that are
    not held out; the threshold is taken over all of those.  A null text
    counts as empty, and empty texts are scored like any other; a null id is
    not held out and never trains; with one class only, every score is 0.5;
    repeated rows keep their number; an empty table gives no rows.
    """
    train = training_rows(docs, labels, "quality", train_rows)
    w = fit(train.select("doc_id", "y", feature_array(F.col("text")).alias("x")), each)
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg(F.max("quality").alias("y"))
    # scored where they are read: the shuffle to the labels moves a number a row, no text
    known = docs.where(F.col("text").isNotNull() & ~held_out()).select("doc_id", raw_score(feature_array(F.col("text")), w).alias("raw"))
    scored = save(known.join(y, "doc_id").select("raw", "y"), "bt-known")
    t = quantile_threshold(scored) if np.any(w) else 0.0
    raw = raw_score(feature_array(F.col("text")), w)
    return 1 / (1 + F.exp(F.lit(t) - raw))
