"""Source divergence audit by count-level bitmaps.

For each group (a source of a language) and each count, the ids of the terms
with that count are a bitset, cut into blocks of ``BLOCK`` ids; ids go by
falling frequency, so a block holds few counts.  The terms with count a in
one group and b in another are the popcount of the AND of two bitsets; zeros
are the complement of all levels of a block.  Those joint cells times the
difference of the two smoothed shares, summed over the blocks, is the
divergence of the pair.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.llm.common import save
from sparktab.operators.sequence import seq_number

BLOCK = 256  # term ids in a block: WORDS longs
WORDS = BLOCK // 64
SOURCES = 32  # about so many sources of a language are compared in one task
SCALE = 1_000_000_000
PIECE = 4 << 20  # bytes of a text split at once

# letters of either case to small ones, bytes of other characters stay, all else separates
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(raw: bytes):
    """The terms of a UTF-8 text, lists of at most about ``PIECE`` bytes at a time."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and _LETTERS[raw[end]] != 0x20:
            end += 1
        yield raw[at:end].translate(_LETTERS).split()
        at = end


def term_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """``docs`` (lang, source, text) -> (lang, source, term, n, df), summed over
    the documents; one row with a null term for each (lang, source).  A task
    adds up in memory and hands out what it has at ``flush`` entries."""
    schema = "lang string, source string, term string, n bigint, df bigint"

    def count(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out():
            for (lang, source), (n, df) in held.items():
                t = list(n)
                yield pd.DataFrame({"lang": [lang] * (len(t) + 1), "source": [source] * (len(t) + 1),
                                    "term": pd.Series([None, *(x.decode() for x in t)], dtype=object),
                                    "n": [0, *(n[x] for x in t)], "df": [0, *(df[x] for x in t)]})

        for pdf in batches:
            for lang, source, raw in zip(pdf["lang"], pdf["source"], pdf["text"]):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                seen = set()
                for found in terms(raw):
                    n.update(found)
                    seen.update(found)
                df.update(seen)
            if sum(len(n) for n, _ in held.values()) > flush:
                yield from out()
                held = {}
        yield from out()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    return d.mapInPandas(count, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 v)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(27,0)")
    top = (wide(n + 5) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return (F.call_function("div", top, wide(total + 5 * v)) + 1).cast("bigint")


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """``docs`` (lang, source, text) -> (lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language, by summed difference of
    the term shares; part ``term``: the ``top_terms`` terms that stand out
    most against the language.  Null text, lang and source count as ''; a
    group without terms has its pairs all the same, of value 0 if the
    language keeps no term; ties go by item; repeated rows count each time;
    an empty table gives no rows; other columns are ignored.
    """
    counts = save(term_counts(docs), "div-counts")
    vocab = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")) \
        .where(F.col("df") >= least_docs).drop("df")
    vocab = seq_number(vocab, ["lang"], [F.desc("lang_n"), "term"], "id")
    kept = save(counts.join(vocab, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", (F.col("id") - 1).alias("id")), "div-kept")
    langs = vocab.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source") \
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left") \
        .na.fill(0, ["total", "v", "lang_total"])
    groups = save(groups, "div-groups")
    pairs = pair_values(kept, groups).withColumn("part", F.lit("pair"))

    t = kept.join(groups, ["lang", "source"]).withColumn("value", share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v")))
    t = t.where("value > 0 and n > 0").select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by)).unionByName(t.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def bitmaps(kept: DataFrame) -> DataFrame:
    """(lang, source, term id, n) -> one row per (lang, source, n, block) with the block's bitset b0, b1, ..."""
    word, bit = F.col("id") % BLOCK / 64, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("id") % 64).cast("int"))
    return kept.groupBy("lang", "source", "n", F.floor(F.col("id") / BLOCK).alias("block")).agg(
        *[F.bit_or(F.when(F.floor(word) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"b{i}") for i in range(WORDS)])


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of groups of a language.

    A task compares the levels of one block of term ids for two slices of
    about ``SOURCES`` sources, so neither a large vocabulary nor many sources
    meet in one task."""
    bits = [f"b{i}" for i in range(WORDS)]
    zero = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("v") / BLOCK) - 1)))) \
        .select("lang", "source", "block", F.lit(0).cast("bigint").alias("n"), *[F.lit(0).cast("bigint").alias(b) for b in bits])
    slices = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("slices"))
    per = groups.join(slices, "lang").withColumn("own", F.pmod(F.xxhash64("source"), "slices").cast("int"))
    rows = bitmaps(kept).select("lang", "source", "block", "n", *bits).unionByName(zero).join(per, ["lang", "source"]) \
        .withColumn("p", F.when(F.col("v") > 0, share(F.col("n"), F.col("total"), F.col("v"))).otherwise(F.lit(0))) \
        .withColumn("valid", F.least(F.lit(BLOCK), F.col("v") - F.col("block") * BLOCK).cast("int")) \
        .withColumn("with", F.explode(F.expr("sequence(0, slices - 1)"))) \
        .select("lang", "block", F.least("own", "with").alias("c1"), F.greatest("own", "with").alias("c2"), "own", "source", "n", "p", "valid", *bits)

    def joint(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "n"], kind="stable")
        b = np.ascontiguousarray(pdf[bits].to_numpy(np.int64)).view(np.uint64)
        p, own, name = pdf["p"].to_numpy(np.int64), pdf["own"].to_numpy(), pdf["source"].to_numpy(object)
        start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        end = np.append(start[1:], len(name))
        valid = int(pdf["valid"].iloc[0])
        full = np.array([(1 << min(64, max(0, valid - 64 * i))) - 1 for i in range(WORDS)], np.uint64)
        for a, z in zip(start, end):  # a source's first row is its zero level: the complement of the others
            b[a] = full & ~np.bitwise_or.reduce(b[a + 1:z], axis=0, initial=np.uint64(0))
        c1, c2 = int(pdf["c1"].iloc[0]), int(pdf["c2"].iloc[0])
        left, right, value = [], [], []
        for k, (a, z) in enumerate(zip(start, end)):
            if own[a] != c1 or k + 1 == len(start) and c1 == c2:
                continue
            lo = end[k] if c1 == c2 else 0
            sums = np.zeros(len(p) - lo, np.int64)
            for i in range(a, z):
                cells = np.bitwise_count(b[lo:] & b[i]).sum(axis=1, dtype=np.int64)
                sums += cells * np.abs(p[lo:] - p[i])
            seg = start[k + 1:] if c1 == c2 else start
            for s, v in zip(seg, np.add.reduceat(sums, seg - lo).tolist()):
                if c1 == c2 or own[s] == c2:
                    left.append(name[a])
                    right.append(name[s])
                    value.append(v)
        return pd.DataFrame({"a": pd.Series(left, dtype=object), "b": pd.Series(right, dtype=object), "value": np.array(value, np.int64),
                             "lang": pd.Series([pdf["lang"].iloc[0]] * len(left), dtype=object)})

    half = rows.groupBy("lang", "block", "c1", "c2").applyInPandas(joint, "a string, b string, value bigint, lang string") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return half.withColumn("s", F.explode(both)).select("lang", "s.source", "s.item", "value")
