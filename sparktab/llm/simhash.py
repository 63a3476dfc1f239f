"""SimHash near-duplicates by vantage-point trees over Hamming distance.

A fingerprint is 64 bits over word shingles.  The distinct fingerprints (one
row for each, however many documents share it) are dealt to the leaves of a
vantage-point tree; one that lies within the allowed distance of a boundary
is also sent, as a query, to the shards across it, so that every pair within
that distance meets in exactly one leaf.  A leaf compares its queries and
members within the triangle bounds of a pivot of its own and returns a
spanning forest of the links it finds, so rows out stay below rows in however
dense a group is.  Components are joined across leaves by ``graph``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import save, text_key, trim, unused
from sparktab.llm.graph import components


def simhash64(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text: lower-cased A-Z, words between ASCII white
    space, shingles of ``words`` words with repeats, XXH64 of each; no words: 0."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = partial(xxhash.xxh64_digest, seed=seed)
    counts, n, part = np.zeros(64, np.int64), 0, []
    for s in shingles:
        part.append(digest(s))
        if len(part) == 65536:  # bounds the bit matrix of a very long text
            counts, n, part = counts + _bit_counts(part), n + len(part), []
    counts, n = counts + _bit_counts(part), n + len(part)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _bit_counts(digests: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed bigint (its 64 bits)."""
    @F.pandas_udf("bigint")
    def fp(t: pd.Series) -> pd.Series:
        out = pd.Series(np.array([simhash64(x, words) for x in t], np.uint64).view(np.int64))
        trim()
        return out
    return fp(text)


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def build_tree(sample: np.ndarray, depth: int, least: int = 16) -> list:
    """Vantage points and radii from a sample of distinct fingerprints.  Nodes
    are [vantage, radius, left, right] or [None, share] for a leaf; share is
    the part of the sample that fell there."""
    nodes: list = []

    def grow(x: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append(None)
        best = None
        if level < depth and len(x) >= 2 * least:
            for v in x[:: max(1, len(x) // 8)][:8]:  # of a few candidates, the one that splits most evenly
                d = hamming(x, v)
                r = int(np.median(d))
                r -= (d <= r).mean() > 0.75 and r > 0
                share = (d <= r).mean()
                if 0 < share < 1 and (best is None or abs(share - 0.5) < best[0]):
                    best = (abs(share - 0.5), v, r, d <= r)
        if best is None:
            nodes[at] = [None, len(x) / max(1, len(sample))]
        else:
            _, v, r, left = best
            nodes[at] = [int(v), r, grow(x[left], level + 1), grow(x[~left], level + 1)]
        return at

    grow(sample, 0)
    return nodes


def route(nodes: list, fps: np.ndarray, bits: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, members, queries) as indexes into ``fps``.  Of two fingerprints
    that a node parts, the left one also goes right as a query if it is within
    ``bits`` of the boundary; queries go wherever the bounds allow."""
    out, todo = [], [(0, np.arange(len(fps)), np.arange(0))]
    while todo:
        at, home, query = todo.pop()
        node = nodes[at]
        if not len(home) and not len(query):
            continue
        if node[0] is None:
            out.append((at, home, query))
            continue
        v, r, left, right = node
        dh, dq = hamming(fps[home], np.uint64(v)), hamming(fps[query], np.uint64(v))
        inside = dh <= r
        todo.append((left, home[inside], query[dq <= r + bits]))
        todo.append((right, home[~inside], np.concatenate([query[dq > r - bits], home[inside & (dh > r - bits)]])))
    return out


def leaf_forest(home: np.ndarray, query: np.ndarray, bits: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``bits`` among members, and between queries and members, as
    a spanning forest (fingerprint, its group's smallest one)."""
    home = np.unique(home)
    if not len(home):
        return home, home
    pivot = home[0]
    home = home[np.argsort(hamming(home, pivot), kind="stable")]
    dh = hamming(home, pivot)
    every = np.concatenate([home, np.setdiff1d(query, home)])
    de = hamming(every, pivot)
    order = np.argsort(de, kind="stable")
    group = np.arange(len(every))
    for i in range(0, len(order), block):
        rows = order[i:i + block]
        lo = np.searchsorted(dh, de[rows[0]] - bits)
        hi = np.searchsorted(dh, de[rows[-1]] + bits, side="right")
        near = np.bitwise_count(every[rows][:, None] ^ home[None, lo:hi]) <= bits
        for k in np.flatnonzero(near.any(axis=1)):
            linked = np.unique(np.append(group[lo + np.flatnonzero(near[k])], group[rows[k]]))
            if len(linked) > 1:
                group[np.isin(group, linked)] = linked[0]
    label, where, size = np.unique(group, return_inverse=True, return_counts=True)
    low = np.full(len(label), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, where, every)
    keep = (size[where] > 1) & (low[where] != every)
    return every[keep], low[where][keep]


def link_fingerprints(distinct: DataFrame, bits: int = 3, leaf_rows: int = 4000, max_leaves: int = 4096,
                      sample_rows: int = 65536) -> DataFrame:
    """``distinct`` (fp bigint, no repeats, written) -> edges (a, b) that connect
    all pairs within ``bits``.  The tree is learnt from at most ``sample_rows``
    fingerprints taken by hash; a leaf expected to hold more than ``leaf_rows``
    members is cut into chunks, each compared with all its queries."""
    spark = distinct.sparkSession
    n = distinct.count()
    picked = distinct.orderBy(F.xxhash64("fp", F.lit(11)), "fp").limit(sample_rows).toPandas()["fp"]  # bounded
    sample = picked.to_numpy(np.int64).view(np.uint64)
    depth = 0 if n <= leaf_rows else int(np.ceil(np.log2(min(n / leaf_rows, max_leaves))))
    nodes = build_tree(sample, depth)
    chunks = {i: max(1, int(np.ceil(x[1] * n / leaf_rows / 2))) for i, x in enumerate(nodes) if x[0] is None}

    def deal(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            rows = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.uint64))]
            for leaf, home, query in route(nodes, fps, bits):
                c = chunks[leaf]
                own = (fps[home] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % c
                for j in range(c):
                    member, asks = home[own == j], np.concatenate([query, home[own < j]])
                    f = np.concatenate([fps[member], fps[asks]])
                    rows.append((np.full(len(f), np.int64(leaf) * 2**20 + j), np.arange(len(f)) >= len(member), f))
            leaf, asks, f = map(np.concatenate, zip(*rows))
            yield pd.DataFrame({"leaf": leaf, "asks": asks, "fp": f.view(np.int64)})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        asks = pdf["asks"].to_numpy(bool)
        a, b = leaf_forest(f[~asks], f[asks], bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInPandas(deal, "leaf bigint, asks boolean, fp bigint")
    return dealt.groupBy("leaf").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, fp, component_id), one row for
    each row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``bits`` or
    fewer differing bits, itself included.  Null, empty and blank texts have
    fingerprint zero and link like any other; a null doc_id never names a
    component unless all of its ids are null; repeated rows keep their
    number; an empty table gives no rows; other columns are ignored.
    """
    fps, named = fingerprint_groups(docs, [F.col("doc_id")], F.min("doc_id"), words, bits)
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def fingerprint_groups(docs: DataFrame, keep: list[Column], rep: Column, words: int = 3, bits: int = 3) -> tuple[DataFrame, DataFrame]:
    """(``keep`` columns and fp, one row for each row of ``docs``), (fp, rep,
    root, one row for each fingerprint): ``rep`` aggregates the kept columns,
    and a root stands for one group, whatever ids its rows have."""
    fps = save(docs.select(*keep, fingerprint(F.col("text"), words).alias("fp")), "simhash-fp")
    reps = save(fps.groupBy("fp").agg(rep.alias("rep")), "simhash-distinct")
    comp = save(components(link_fingerprints(reps.select("fp"), bits)), "simhash-comp")
    return fps, reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def one_per_group(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id (a
    null one last), then the smallest text key, then the smallest hash of the
    row; of rows equal in all columns one stays."""
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), text_key().alias("t"), F.xxhash64(*docs.columns).alias("h"))
    at, n = unused(docs, "_place", "_n")
    fps, named = fingerprint_groups(docs, [place.alias(at)], F.min(at), words, bits)
    first = named.groupBy("root").agg(F.min("rep").alias(at)).select(at)
    first = save(first.join(fps.groupBy(at).agg(F.count("*").alias(n)), at), "simhash-first")
    # both sides are dealt by the whole place, never by a null id alone; texts are aggregated only where rows are equal
    rows = docs.withColumn(at, place)
    once = rows.join(first.where(F.col(n) == 1), at, "left_semi")
    more = rows.join(first.where(F.col(n) > 1), at, "left_semi").dropDuplicates([at])
    return once.unionByName(more).select(*docs.columns)


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
