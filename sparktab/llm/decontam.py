"""Benchmark decontamination by spaced-seed hashing, in SQL expressions only.

A seed covers a window of words, of which a fixed mask ignores some, so a
substituted word under an ignored place does no harm; several masks together
tolerate substitutions anywhere.  Seeds of the benchmark and of the documents
are joined by hash; around each hit the item and the document are laid over
each other and counted word by word.  The masks of a length are shown by
enumeration to hit every pattern of substitutions that the count allows, so
the seeds lose nothing.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import text_key, unused

#: 1: the word counts, 0: it is ignored.  The heaviest set that loses nothing is taken; masks begin and end with 1, so
#: one that hits lies inside the document.
MASK_SETS = (("11111", "111011"), ("1111", "11011"), ("111", "1101"))
MOST_PATTERNS = 50_000  # to enumerate
SEED_BYTES = 200  # of a benchmark seed, its item's words included, on average at most


def words_of(text):
    """Lower-case runs of letters and digits; everything else parts words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def missed(masks, words: int, wrong: int) -> int:
    """How many of the patterns of ``wrong`` substituted among ``words`` words no mask hits at any place."""
    laid = [sum(1 << (at + i) for i, c in enumerate(m) if c == "1") for m in masks for at in range(words - len(m) + 1)]
    patterns = (sum(1 << i for i in p) for p in combinations(range(words), wrong))
    return sum(all(x & p for x in laid) for p in patterns)


@lru_cache(None)
def masks_for(words: int, least: float) -> tuple[str, ...]:
    """Masks that hit ``words`` words of which at least the share ``least`` is
    equal, wherever the others are.  Without substitutions it is the whole;
    where no set is proven, the unbroken run that must be left between them."""
    wrong = max(k for k in range(words + 1) if k == 0 or (k < words and words - k >= words * least))
    if wrong and comb(words, wrong) <= MOST_PATTERNS:
        for masks in MASK_SETS:
            if not missed(masks, words, wrong):
                return masks
    return ("1" * min(words, ceil((words - wrong) / (wrong + 1))),) if wrong else ("1" * words,)


def seeds(df: DataFrame, words: str, masks, of=None) -> DataFrame:
    """A row for each seed: the columns of ``df``, ``at`` (its first word) and
    ``seed``; ``of`` maps a mask to a condition on the rows it is laid on."""
    shortest = min(map(len, masks), default=1)
    at = df.where(F.size(words) >= shortest).select("*", F.explode(F.sequence(F.lit(0), F.size(words) - shortest)).alias("at"))
    hashed = [F.when((F.col("at") + len(mask) <= F.size(words)) & (of(mask) if of else F.lit(True)),
                     F.xxhash64(F.lit(mask), *[F.get(words, F.col("at") + i) for i, c in enumerate(mask) if c == "1"])) for mask in masks]
    return at.select("*", F.explode(F.array(*hashed).cast("array<bigint>")).alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, window: int = 20,
             broadcast_bytes: int = 64_000_000) -> DataFrame:
    """(doc_id, text_key, item_id, matched, item_words): documents that hold a
    benchmark item, or ``window`` neighbouring words of one, with at least
    ``least`` of the words equal place by place.

    Items shorter than ``window`` must match as a whole; an item without words
    matches nothing.  Only masks that some item's length asks for are laid on
    the documents.  The benchmark's seeds are broadcast
    only if their counted size is within ``broadcast_bytes``, else joined by
    shuffle.  Null texts match nothing; repeated rows give one row; rows with
    a null item_id are left out; extra columns are ignored.
    """
    items = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("iw")).distinct()
    part = F.least(F.lit(window), F.size("iw"))
    parts = [r[0] for r in items.select(part).distinct().collect() if r[0]]  # at most `window` numbers
    masks = sorted({m for p in parts for m in masks_for(p, least)})
    asked = lambda mask: part.isin([p for p in parts if mask in masks_for(p, least)])
    probe = seeds(items, "iw", masks, asked).select("seed", F.col("at").alias("item_at"), "item_id", "iw")
    size = probe.agg(F.count("*").alias("n"), F.sum(F.expr("aggregate(iw, 0L, (s, w) -> s + octet_length(w) + 16)")).alias("b")).first()
    if (size["b"] or 0) + 64 * size["n"] <= broadcast_bytes:
        probe = F.broadcast(probe)
    texts = docs.select("doc_id", text_key().alias("text_key"), words_of(F.col("text").cast("string")).alias("dw"))
    hits = seeds(texts, "dw", masks).join(probe, "seed")
    diag = F.col("at") - F.col("item_at")
    # the document's words under the item, from its first to its last place; outside the document there is none
    lo = F.greatest(diag, F.lit(0))
    under = F.slice("dw", lo + 1, F.size("iw") - (lo - diag))
    laid = hits.groupBy("doc_id", "text_key", "item_id", diag.alias("diag")).agg(F.first(under).alias("under"), F.first("iw").alias("iw"), F.first(lo - diag).alias("skip"))
    same = F.transform(F.sequence(F.lit(0), F.size("iw") - 1),
                       lambda i: F.coalesce((F.get("under", i - F.col("skip")) == F.get("iw", i)) & (i >= F.col("skip")), F.lit(False)).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    dense = F.exists(F.sequence(F.lit(1), F.size("iw") - part + 1), lambda s: total(F.slice("same", s, part)) >= part * least)
    found = laid.withColumn("same", same).withColumn("matched", total(F.col("same"))).where((F.col("matched") >= part * least) & dense)
    return found.groupBy("doc_id", "text_key", "item_id").agg(F.max("matched").cast("int").alias("matched"), F.max(F.size("iw")).alias("item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, text_key, items, matched): one row for each contaminated text."""
    return overlaps(docs, benchmark, **how).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("matched").alias("matched"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the contaminated rows; every other row stays as it is,
    null and empty texts too."""
    k, i, key = unused(docs, "_k", "_id", "_key")
    bad = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias(i), F.col("text_key").alias(key))
    return docs.withColumn(k, text_key()).join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(k) == F.col(key)), "left_anti") \
        .select(*docs.columns)
