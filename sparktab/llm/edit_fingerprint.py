"""Document fingerprints by a randomised edit embedding.

A walk reads the characters of a text: at step j it emits the character it
stands on and moves on or stays, by a random bit that all texts share for
that step and character.  Two texts with few edits fall into step again soon
after each edit, so their edit distance becomes the Hamming distance of the
emitted sequences.  The fingerprint samples that sequence: each of its slots
keeps the characters at the step with the lowest rank among the slot's steps
so far, so texts of different lengths are sampled at mostly the same steps.
Bands of slots give candidates, the share of equal slots verifies them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import save
from sparktab.llm.graph import components

SLOTS = 128
PERIOD = 8192  # steps after which the shared random bits repeat
END = 255  # class of the place behind a text: the walk stays there
CHANCE = 0.09  # share of equal slots of unrelated texts
_HEX = np.frombuffer(b"0123456789abcdef.", np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BITS = (_mix(np.arange(PERIOD * 256, dtype=np.uint64)) >> np.uint64(17) & np.uint64(1)).astype(np.uint8).reshape(PERIOD, 256)
_BITS[:, END] = 0
_ROWS = [r.tobytes() for r in _BITS]
_RECORDS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def records(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps below a power of two at which some slot meets a new lowest rank, and the slots."""
    size = 1 << max(10, int(steps).bit_length())
    if size not in _RECORDS:
        h = _mix(np.arange(size, dtype=np.uint64) + np.uint64(977))
        slot, rank = (h & np.uint64(SLOTS - 1)).astype(np.int64), h >> np.uint64(8)
        hit = np.zeros(size, bool)
        for s in range(SLOTS):
            at = np.flatnonzero(slot == s)
            low = np.minimum.accumulate(rank[at])
            hit[at[np.concatenate([[True], low[1:] < low[:-1]])]] = True
        _RECORDS[size] = np.flatnonzero(hit), slot[hit]
    return _RECORDS[size]


def _classes(text: str) -> bytes:
    """One of 255 classes for each code point, and a few places behind the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return (_mix(codes) % np.uint64(255)).astype(np.uint8).tobytes() + bytes([END]) * 4


def fingerprints(texts: list[str]) -> np.ndarray:
    """(len(texts), SLOTS) symbols 0..15, 16 for a slot that met no step.  All
    walks go on side by side; the last few long ones one by one."""
    parts = [_classes(t) for t in texts]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(size) - size
    out = np.full((len(texts), SLOTS), 16, np.uint8)
    live = np.flatnonzero(size > 4)
    pos = start[live].copy()
    steps, slots = records(4 * int(size.max(initial=4)))
    k, j = 0, 0

    def symbol(p):
        v = buf[p].astype(np.uint64) << np.uint64(16) | buf[p + 1].astype(np.uint64) << np.uint64(8) | buf[p + 2]
        return (_mix(v) >> np.uint64(40) & np.uint64(15)).astype(np.uint8)

    while len(live) > 40:
        upto = j + 64
        while j < upto:
            if k < len(steps) and steps[k] == j:
                on = buf[pos] != END
                out[live[on], slots[k]] = symbol(pos[on])
                k += 1
            pos += _BITS[j % PERIOD][buf[pos]]
            j += 1
        on = buf[pos] != END
        if not on.all():
            live, pos = live[on], pos[on]
        if 2 * j > steps_known(steps):
            steps, slots = records(8 * j)
    for d, p in zip(live.tolist(), pos.tolist()):
        t = parts[d]
        i, at, kk = p - int(start[d]), j, k
        mine, of = steps, slots
        while t[i] != END:
            if kk >= len(mine):
                mine, of = records(2 * steps_known(mine) + 2)
            stop = int(mine[kk]) if kk < len(mine) else steps_known(mine)
            while at < stop and t[i] != END:
                a = at % PERIOD
                n = min(stop - at, PERIOD - a, 512)
                for row in _ROWS[a:a + n]:
                    i += row[t[i]]
                at += n
            if t[i] == END:
                break
            if kk < len(mine) and mine[kk] == at:
                out[d, of[kk]] = symbol(np.array([start[d] + i]))[0]
                kk += 1
    return out


def steps_known(steps: np.ndarray) -> int:
    """Steps that a record list covers."""
    return next(n for n, (s, _) in _RECORDS.items() if s is steps)


def to_text(fp: np.ndarray) -> list[str]:
    return [r.tobytes().decode() for r in _HEX[fp]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either has, freed of what unrelated texts share; 1 for two empty ones."""
    used = ((a < 16) | (b < 16)).sum(-1)
    same = ((a == b) & (a < 16)).sum(-1)
    share = np.where(used > 0, same / np.maximum(used, 1), 1.0)
    return np.maximum(0.0, (share - CHANCE) / (1 - CHANCE))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, fingerprint): see ``compare_edited``
    for odd rows."""
    @F.pandas_udf("string")
    def fp(t: pd.Series) -> pd.Series:
        return pd.Series(to_text(fingerprints([x or "" for x in t])))
    return docs.select("doc_id", fp(F.col("text").cast("string")).alias("fingerprint"))


_COMPARED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def _compare(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
    import hashlib
    edited = []
    for t, nxt in zip(texts, following):
        q = len(t) // 4
        edited.append(t[:len(t) - q] + nxt[:q])
    own, other = fingerprints(texts + edited), fingerprints(following[-1:])
    n = len(texts)
    fp, fe = own[:n], own[n:]
    after = np.concatenate([fp[1:], other]) if n else fp
    return pd.DataFrame({
        "doc_id": pd.array(ids, "Int64"), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": to_text(fp), "edited_fingerprint": to_text(fe), "near_edited": likeness(fp, fe), "near_next": likeness(fp, after)})


def compare_edited(docs: DataFrame, slice_chars: int = 6_000_000) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, whose last
    quarter is the start of the next document's text, and how alike they and
    the next document's are.

    Documents go by doc_id (null first), then text; after the last comes the
    first.  One range shuffle brings neighbours together; a task reads its
    rows in order, ``slice_chars`` at a time, and hands its first and last row
    to a second, small step that joins neighbouring tasks.  A null text counts
    as empty; an empty text's fingerprint has no slot and is like another
    empty one only; a single row is its own next; repeated rows are rows of
    their own; an empty table gives no rows; other columns are ignored.
    """
    def tasks(batches):
        import pyspark
        part = pyspark.TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        first, chars = None, 0

        def edge(kind, doc, text):
            return pd.DataFrame({"doc_id": pd.array([doc], "Int64"), "kind": [kind], "part": [part], "text": [text]})

        def done(d):
            return d.assign(kind=0, part=part, text=None)

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                doc = None if pd.isna(doc) else int(doc)
                if first is None:
                    first = (doc, text)
                    yield _full(edge(1, doc, text))
                if chars >= slice_chars and len(ids) > 1:  # the last one waits for its next
                    yield _full(done(_compare(ids[:-1], texts[:-1], texts[1:])))
                    ids, texts, chars = ids[-1:], texts[-1:], 0
                ids.append(doc)
                texts.append(text)
                chars += len(text)
        if ids:
            if len(ids) > 1:
                yield _full(done(_compare(ids[:-1], texts[:-1], texts[1:])))
            yield _full(edge(2, ids[-1], texts[-1]))

    def _full(d):
        for c, v in (("n_chars", 0), ("edited_sha256", None), ("fingerprint", None), ("edited_fingerprint", None), ("near_edited", 0.0), ("near_next", 0.0)):
            if c not in d:
                d[c] = v
        return d[["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kind", "part", "text"]]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    out = save(ordered.mapInPandas(tasks, f"{_COMPARED}, kind int, part int, text string"), "edit-walks")
    edges = out.where("kind > 0")
    used = sorted(r["part"] for r in edges.where("kind = 1").select("part").collect())  # at most one a task
    if not used:
        return out.drop("kind", "part", "text")
    links = docs.sparkSession.createDataFrame([(a, b) for a, b in zip(used, used[1:] + used[:1])], "part int, next_part int")
    pairs = edges.where("kind = 2").join(links, "part").select("doc_id", "text", "next_part").join(
        edges.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part")

    def last_ones(batches):
        for pdf in batches:
            for doc, text, nxt in zip(pdf["doc_id"], pdf["text"], pdf["next_text"]):
                yield _compare([None if pd.isna(doc) else int(doc)], [text], [nxt])

    last = pairs.select("doc_id", "text", "next_text").mapInPandas(last_ones, _COMPARED)
    return out.where("kind = 0").drop("kind", "part", "text").unionByName(last)


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 16, chunk: int = 2000) -> DataFrame:
    """(doc_id, fingerprint, group_id): documents joined by links of at least
    ``least`` likeness that share a band of sampled slots; group_id is the
    smallest doc_id of the group.

    Equal fingerprints are one row from the start.  A band's bucket with more
    than ``chunk`` members is cut into chunks and every pair of chunks is
    compared in a task of its own; each task gives a spanning forest of its
    links, so rows out grow with rows in.
    """
    width = SLOTS // bands
    fps = save(fingerprint(docs), "edit-fp")
    reps = save(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.xxhash64("fingerprint").alias("node")), "edit-distinct")
    keyed = reps.select("node", "fingerprint", F.posexplode(F.expr(
        f"transform(sequence(0, {bands - 1}), b -> substring(fingerprint, b * {width} + 1, {width}))")).alias("band", "bits"))
    sizes = keyed.groupBy("band", "bits").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.count("*").alias("members")).where("members > 1")
    dealt = keyed.join(sizes, ["band", "bits"]).withColumn("own", F.pmod("node", F.col("chunks")).cast("int")) \
        .withColumn("with", F.explode(F.expr("sequence(0, chunks - 1)"))) \
        .select("band", "bits", F.least("own", "with").alias("c1"), F.greatest("own", "with").alias("c2"), "node", "fingerprint")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        fp = np.frombuffer("".join(pdf["fingerprint"]).encode(), np.uint8).reshape(len(pdf), SLOTS)
        fp = np.where(fp == ord("."), 16, np.where(fp >= ord("a"), fp - ord("a") + 10, fp - ord("0"))).astype(np.uint8)
        group = np.arange(len(pdf))
        for i in range(len(pdf)):
            near = np.append(np.flatnonzero(likeness(fp[i:i + 1], fp) >= least), i)
            linked = np.unique(group[near])
            if len(linked) > 1:
                group[np.isin(group, linked)] = linked[0]
        return pd.DataFrame({"a": node, "b": node[group]})

    edges = dealt.groupBy("band", "bits", "c1", "c2").applyInPandas(forest, "a bigint, b bigint")
    comp = components(edges).withColumnRenamed("node", "n")
    named = reps.join(comp, reps["node"] == comp["n"], "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("rep").alias("group_id")).join(named.select("root", "fingerprint"), "root").drop("root")
    return fps.join(ids, "fingerprint").select("doc_id", "fingerprint", "group_id")
