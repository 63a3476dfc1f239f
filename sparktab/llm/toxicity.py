"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, look-alike letters of other scripts,
digits and signs written for letters.  The lexicon is learnt from labelled
rows: word beginnings and whole words far more frequent in toxic texts, each
weighted by its log odds.  Phrases around an entry that occur in clean texts
only are exceptions and cancel the hit inside them.  The summed weight is
normalised by the length of the text and calibrated to 0..1.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import frame, held_out, save, training_rows

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "b", "ɑ": "a", "ɡ": "g",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}

SHORTEST, LONGEST = 4, 7  # letters of a word beginning
_SIGN_RUN = re.compile(r"(?<![^\W_])?[0-9@$!|€£]+(?=[^\W\d_])")
_END_RUN = re.compile(r"(?<=[^\W\d_])[013456789@$!|€£]+")
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")


@lru_cache(1)
def _table() -> dict[int, str]:
    """Accented Latin letters to their base by Unicode decomposition, and the look-alikes in either case."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii():
            out[code] = base.lower()
    for k, v in LOOKALIKES.items():
        out[ord(k)] = v
        if len(k.upper()) == 1 and k.upper() != k and not k.upper().isascii():
            out[ord(k.upper())] = v
    # i and l are often written for each other: one class
    for code, v in list(out.items()):
        out[code] = "i" if v == "l" else v
    for c in "ABCDEFGHIJKMNOPQRSTUVWXYZ":
        out[ord(c)] = c.lower()
    out[ord("L")] = out[ord("l")] = "i"
    return out


def _spelt(text: str | None) -> str:
    """The text without hidden characters, signs before a letter as letters."""
    t = text or ""
    if not t.isascii():
        if max(t) > "ɏ":
            t = unicodedata.normalize("NFKC", t)
        t = _HIDDEN.sub("", t)
    return _SIGN_RUN.sub(lambda m: "".join(SIGNS.get(c, c) for c in m[0]), t) if re.search(r"[0-9@$!|€£](?=[^\W\d_])", t) else t


def _words(spelt: str) -> str:
    return " " + " ".join(re.findall(r"[^\W\d_]+", spelt.translate(_table()))) + " "


def fold(text: str | None) -> str:
    """Folded words with one blank around each; nothing else is left.  Signs
    at a word's end are punctuation here; ``readings`` has them as letters too."""
    return _words(_spelt(text))


def readings(text: str | None) -> tuple[str, str]:
    """``fold`` of a text, and the same words with the signs at their ends as
    letters (h4t3: hat, hate), or '' if no word has one."""
    t = _spelt(text)
    other = _END_RUN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), t)
    return _words(t), _words(other) if other != t else ""


def entries_of(folded: str) -> set[str]:
    """Candidate entries of a folded text: ' ' + beginning, and ' ' + word + ' '."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


def learn_lexicon(train: DataFrame, most: int = 2000, least_docs: int = 3, purity: float = 0.6) -> tuple[list, list]:
    """[(entry, weight)], [exception phrase] from ``train`` (doc_id, text, y).

    Support is counted over distinct texts, and in toxic texts over distinct
    neighbouring words, so copies and near copies of one toxic text don't make
    its other words entries.  An entry is mostly toxic (``purity``) and has a
    likelihood ratio beyond what the number of candidates gives by chance.  Of
    nested entries the longer one stays if it holds nearly as many texts, else
    the shorter one.  At most ``most`` entries.
    """
    rows = train.groupBy("text").agg(F.max("y").alias("y"))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        return [], []

    def counts(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"]):
                seen[y].update(entries_of(fold(text)))
        names = list({*seen[0], *seen[1]})
        yield frame(entry=(names, object), pos=([seen[1][e] for e in names], "int64"), neg=([seen[0][e] for e in names], "int64"))

    c = rows.mapInPandas(counts, "entry string, pos bigint, neg bigint").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    c = save(c.where(F.col("pos") > 0), "tox-entries")
    candidates = c.count()
    need = math.log(max(2, candidates)) + 3
    base = pos / (pos + neg)
    n = F.col("pos") + F.col("neg")
    share = F.col("pos") / n
    xlog = lambda x, p: F.when(x > 0, x * F.log(p)).otherwise(0.0)
    ratio = xlog(F.col("pos"), share / base) + xlog(F.col("neg"), (F.col("neg") / n) / (1 - base))
    good = c.where((F.col("pos") >= least_docs) & (share > max(purity, base))).withColumn("ratio", ratio).where(F.col("ratio") > need)
    # bounded by the parameters: `most` * 4 entries, and the labelled rows
    good = good.orderBy(F.desc("ratio"), F.length("entry"), "entry").limit(4 * most).collect()
    if not good:
        return [], []
    known = {r["entry"]: r for r in good}

    def contexts(batches):
        matcher = automaton({e: 1.0 for e in known}, [])
        for pdf in batches:
            got = set()
            for text in pdf["text"]:
                t = fold(text)
                for end, (e, _) in matcher.iter(t):
                    a = end - len(e) + 1
                    z = t.index(" ", a + 1)
                    got.add((e, t[t.rfind(" ", 0, a) + 1 if a else 0:a] + "|" + t[z + 1:max(z + 1, t.find(" ", z + 1))]))
            yield frame(entry=((e for e, _ in got), object), context=((x for _, x in got), object))

    fresh = {r["entry"]: r["n"] for r in rows.where("y = 1").select("text").mapInPandas(contexts, "entry string, context string")
             .groupBy("entry").agg(F.count_distinct("context").alias("n")).collect()}
    taken: dict[str, object] = {}
    for r in sorted(good, key=lambda r: (len(r["entry"]), r["entry"])):
        n = min(r["pos"], fresh.get(r["entry"], 0))
        if n < least_docs or n * math.log(n / (n + r["neg"]) / base) + r["neg"] * math.log(max(1e-9, r["neg"] / (n + r["neg"]) / (1 - base))) <= need:
            continue
        inner = [e for k in range(SHORTEST + 1, len(r["entry"])) if (e := r["entry"][:k]) in taken]
        if all(r["pos"] >= 0.9 * taken[e]["pos"] for e in inner):
            for e in inner:
                del taken[e]
            taken[r["entry"]] = r
    taken = sorted(taken.values(), key=lambda r: (-r["ratio"], r["entry"]))[:most]
    lexicon = [(r["entry"], math.log((r["pos"] + 0.5) / (pos + 1)) - math.log((r["neg"] + 0.5) / (neg + 1))) for r in taken]

    def phrases(batches):
        """Two-word phrases around hits, with the classes they occur in."""
        matcher, seen = automaton(dict(lexicon), []), {0: Counter(), 1: Counter()}
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"]):
                t = fold(text)
                got = set()
                for end, (e, _) in matcher.iter(t):
                    a = end - len(e) + 1
                    z = t.index(" ", a + 1)
                    before, after = t.rfind(" ", 0, a) if a else -1, t.find(" ", z + 1)
                    got.update(p for p in (t[before:z + 1] if before >= 0 else "", t[a:after + 1] if after >= 0 else "") if p)
                seen[y].update(got)
        both = [*{*seen[0], *seen[1]}]
        yield frame(phrase=(both, object), pos=([seen[1][p] for p in both], "int64"), neg=([seen[0][p] for p in both], "int64"))

    ex = rows.mapInPandas(phrases, "phrase string, pos bigint, neg bigint").groupBy("phrase") \
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(f"pos = 0 and neg >= {least_docs}") \
        .orderBy(F.desc("neg"), "phrase").limit(most).collect()
    return lexicon, [r["phrase"] for r in ex]


def automaton(weights: dict[str, float], exceptions: list[str]):
    import ahocorasick
    a = ahocorasick.Automaton()
    for e, w in weights.items():
        a.add_word(e, (e, w))
    for p in exceptions:
        a.add_word(p, (p, None))
    a.make_automaton()
    return a


def _hits(matcher, folded: str) -> tuple[dict[int, float], set[int]]:
    """The heaviest hit at each place outside exception phrases, and the places inside them."""
    spans, hits = [], {}
    for end, (e, w) in matcher.iter(folded):
        at = end - len(e) + 1
        if w is None:
            spans.append((at, end))
        else:
            hits[at] = max(w, hits.get(at, w))
    void = {at for at in hits if any(a <= at < z for a, z in spans)} if spans else set()
    return {at: w for at, w in hits.items() if at not in void}, void


def evidence(matcher, folded: str, other: str = "") -> tuple[float, int]:
    """Summed weight of the hits outside exception phrases, at most one a word
    (the heaviest), and the number of words.  ``other`` is the second reading:
    it counts for the words that differ, unless an exception phrase of the
    first cancels the word."""
    hits, void = _hits(matcher, folded)
    total = sum(hits.values())
    if other:
        second, _ = _hits(matcher, other)
        a = b = 0  # where the word's blank stands in either reading
        for x, y in zip(folded.split(), other.split()) if second else ():
            if x != y and b in second and a not in void:
                total += max(0.0, second[b] - hits.get(a, 0.0))
            a, b = a + len(x) + 1, b + len(y) + 1
    return total, folded.count(" ") - 1


def normalised(weight: float, words: int) -> float:
    """Weight over a damped length: a long text needs somewhat more evidence."""
    return weight / (1 + math.log1p(max(0, words) / 50))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, cut: float = 0.7) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with ``_held_out`` and
    ``_score``: toxicity of every whole text, 0 to 1, ``cut`` at the boundary.

    Lexicon and calibration are learnt from at most ``train_rows`` labelled
    rows that are not held out.  A null text counts as empty, which has no
    hit and the lowest score; a null id is not held out and never trains; a
    training table without one of the classes gives an empty lexicon and
    score 0 everywhere; repeated rows keep their number; an empty table gives
    no rows.
    """
    train = save(training_rows(docs, labels, "toxic", train_rows), "tox-train")
    lexicon, exceptions = learn_lexicon(train)
    weights = dict(lexicon)
    built: list = []  # a task builds its automaton once

    def value(texts: pd.Series) -> np.ndarray:
        if not weights:
            return np.zeros(len(texts))
        if not built:
            built.append(automaton(weights, exceptions))
        matcher = built[0]
        return np.array([normalised(*evidence(matcher, *readings(t))) for t in texts], float)

    def training_values(batches):
        for pdf in batches:
            yield frame(v=(value(pdf["text"]), float), y=(pdf["y"], "int32"))

    seen = train.mapInPandas(training_values, "v double, y int").toPandas()  # at most train_rows numbers
    at, slope = calibrate(seen["v"].to_numpy(), seen["y"].to_numpy())
    shift = math.log(cut / (1 - cut))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        v = value(texts)
        z = np.clip(slope * (v - at) + shift, -30, 30)
        return pd.Series(np.where(v > 0, 1 / (1 + np.exp(-z)), 0.0))

    return docs.withColumn("_held_out", held_out()).withColumn("_score", score(F.col("text")))


def calibrate(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The boundary with the fewest errors, near the lower side of its gap, and a slope that spreads the scores around it."""
    order = np.argsort(v, kind="stable")
    v, y = v[order], y[order]
    if not len(v) or y.min() == y.max() or v[-1] <= 0:
        return 1.0, 1.0
    errors = np.concatenate([[0], np.cumsum(y)]) + (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
    errors = errors.astype(float)
    for i in range(1, len(v)):  # a boundary lies between two different values
        if v[i] == v[i - 1]:
            errors[i] = np.inf
    k = int(np.argmin(errors[1:]) + 1)
    at = float(0.75 * v[k - 1] + 0.25 * v[min(k, len(v) - 1)]) or 1e-6
    above = v[k:]
    return at, 4.0 / max(1e-6, float(np.median(above)) - at if len(above) else 1.0)
