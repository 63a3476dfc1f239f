"""Mixing sources to target weights by a time-varying curriculum.

A source's weight is a schedule over training time 0..1, straight between
knots; its integral is the source's weight in the mix.  Targets in words
follow from the weights, stopped at ``most`` times what a source has.  Inside
a source the documents stand in a fixed pseudo-random order, epoch after
epoch; the words before a copy, as a share of the source's target, are the
cumulative demand at which it is due, and the inverse of the integrated
schedule turns that into the copy's training position.  The mix is the copies
range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.llm.common import running, save

#: (time, weight) knots of the schedules, dealt to the sources in turn; their integrals are 3, 1 and 2.
CURRICULUM = (((0, 4.5), (0.5, 3), (1, 1.5)), ((0, 0.5), (0.5, 0.5), (1, 2.5)), ((0, 2), (1, 2)))
BUCKET_ROWS = 100_000  # documents summed up in one window


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null: each word and the
    blanks behind it become one character, so nothing as long as the text is kept."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(F.ltrim(marks, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("bigint")


def integrals(schedule) -> list[float]:
    """The integral of a schedule up to each of its knots."""
    out = [0.0]
    for (t, w), (u, v) in zip(schedule, schedule[1:]):
        if not t < u or w < 0 or v < 0:
            raise ValueError("a schedule has rising times and weights of 0 or more")
        out.append(out[-1] + (u - t) * (w + v) / 2)
    if not out[-1] > 0:
        raise ValueError("a schedule needs some weight")
    return out


def due(schedule, share: Column) -> Column:
    """The time by which ``share`` (0..1) of the schedule's integral has passed."""
    area = integrals(schedule)
    want = share * area[-1]
    out = None
    for k in range(len(schedule) - 1):
        (t, w), (u, v) = schedule[k], schedule[k + 1]
        rest, slope = want - area[k], (v - w) / (u - t)
        # root of w x + slope x^2 / 2 = rest in the form without cancellation
        root = F.lit(float(w)) + F.sqrt(F.greatest(F.lit(0.0), float(w) ** 2 + 2 * slope * rest))
        at = F.lit(float(t)) + F.least(F.lit(float(u - t)), F.when(root > 0, 2 * rest / root).otherwise(0.0))
        hit = want < area[k + 1] if k < len(schedule) - 2 else F.lit(True)
        out = F.when(hit, at) if out is None else out.when(hit, at)
    return out


def targets(rows: DataFrame, schedules, share: float, most: float) -> DataFrame:
    """``rows`` (source, size) -> (source, absent, src, kind, source_size, target):
    sources by code point (null last) take the schedules in turn; ``share``
    of all words is dealt by weight, and what is above ``most`` times a
    source's size is dealt again among the others until nothing is above.
    Each round is one aggregation over the sources; two numbers come back."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns(
        {"absent": F.col("source").isNull(), "src": F.coalesce("source", F.lit("")), "one": F.lit(1)})
    per = running(per, ["absent", "src"], {"rank": "one"}, "mix-sources")
    weight = [integrals(s)[-1] for s in schedules]
    per = per.withColumn("kind", (F.col("rank") % len(schedules)).cast("int")) \
        .withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weight]), F.col("kind") + 1)).withColumn("top", most * F.col("source_size"))
    per = save(per.drop("one", "rank"), "mix-weights")
    total, free = per.agg(F.sum("source_size"), F.sum("w")).first()
    dealt, taken = share * (total or 0), 0.0
    while free:
        full = F.col("top") <= dealt_to(dealt - taken, free)
        state = per.agg(F.coalesce(F.sum(F.when(full, F.col("top"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if tuple(state) == (taken, free):
            break
        taken, free = state
    goal = F.least(F.col("top"), dealt_to(dealt - taken, free)) if free else F.col("top")
    return per.select("source", "absent", "src", "kind", "source_size", goal.alias("target"))


def dealt_to(amount: float, weights: float) -> Column:
    return F.lit(amount) * F.col("w") / F.lit(weights)


def mix(docs: DataFrame, schedules=CURRICULUM, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The training order of ``docs`` (doc_id, text, source): one row per copy
    (absent, src, bucket, n: its document; doc_id, source, size, source_size,
    target, epoch, words, position), sorted by position.

    A copy is taken whole while its source's target lasts; the last one only
    as far as the target goes, so a source's words are its target rounded
    down.  A document of which nothing is taken has one row with 0 words and
    a null position, behind all others.  The order inside a source is the MD5
    of the id (of the text for a null id), so reruns agree; repeated rows are
    documents of their own.  Null and empty texts have size 0; a null source
    is a source; an empty table gives no rows; other columns are ignored.
    The running sums go by (source, slice of the MD5 range) of about
    ``BUCKET_ROWS`` documents, so a large source is many windows.
    """
    text = F.col("text").cast("string")
    rows = save(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(text).alias("size"),
                            F.md5(F.coalesce(F.col("doc_id").cast("string"), text, F.lit("")).cast("binary")).alias("h")), "mix-sizes")
    per = save(targets(rows, schedules, share, most), "mix-targets")
    buckets = math.ceil(rows.count() / BUCKET_ROWS)
    rows = rows.withColumns({"absent": F.col("source").isNull(), "src": F.coalesce("source", F.lit("")),
                             "bucket": F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0 ** 32 * buckets)})
    key = ["absent", "src", "bucket"]
    earlier = Window.partitionBy("absent", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*key).agg(F.sum("size").alias("held")).withColumn("cell_start", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    cells = cells.join(per.drop("source"), ["absent", "src"]).drop("held")
    w = Window.partitionBy(*key).orderBy("h", "doc_id", "size")
    start = F.col("cell_start") + F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(cells, key).withColumns({"start": start, "n": F.row_number().over(w)})
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)))) \
        .withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")) \
        .withColumn("words", F.greatest(F.lit(0), F.least("size", F.floor("target") - F.col("at"), F.floor(F.lit(most) * F.col("size")) - F.col("epoch") * F.col("size"))))
    copies = copies.where((F.col("epoch") == 0) | (F.col("words") > 0))
    place = None
    for k, s in enumerate(schedules):
        hit = (F.col("kind") == k) & (F.col("words") > 0)
        at = due(s, F.col("at") / F.col("target"))
        place = F.when(hit, at) if place is None else place.when(hit, at)
    order = [F.asc_nulls_last("position"), "absent", "src", "h", "doc_id", "epoch", "n"]
    out = copies.withColumn("position", place).orderBy(*order)
    return out.select(*key, "n", "doc_id", "source", "size", "source_size", "target", "epoch", "words", "position")


def per_document(mixed: DataFrame) -> DataFrame:
    """One row per document of a written mix: (doc_id, size, source_size, target, taken, copies, first_position)."""
    return mixed.groupBy("absent", "src", "bucket", "n").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("words").alias("taken"), F.sum((F.col("words") > 0).cast("int")).alias("copies"), F.min("position").alias("first_position")) \
        .drop("absent", "src", "bucket", "n")
