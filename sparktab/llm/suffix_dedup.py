"""Removal of repeated byte strings by a distributed, common-prefix-aware
merge sort of suffixes.

Which suffixes.  A window is ``length`` bytes.  Every window has one anchor,
the lowest-ranked ``gram`` bytes in it (the last of equals), so equal windows
have equal anchors at equal places in them, and the windows of one anchor are
a run of neighbours, ``o`` bytes before it with ``olo <= o <= ohi``.  Only
anchors whose gram occurs again can hold a repeated window; of each of those
two suffixes are sorted: what follows the anchor, then what stands before it,
read backwards; and the gram, then what stands before it.

The sort.  Each task sorts its suffixes in runs and front-codes them (equal
ones become one), the runs are exchanged by ranges of sampled suffixes, and
each range is merged by a loser tree that carries common prefix lengths, so
no byte known to be common is compared again.  Neighbours in the order then
give, for an anchor, the longest match to the right, the longest to the left,
and pairs of both at once.  A window ``o`` is a repeat if one partner matches
``o`` bytes to the left and ``length - o`` to the right; it is none if no
partner does either.  The few windows that this leaves open, where different
partners reach far to either side, are compared as such.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import save, trim

_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = []
ID = np.dtype([("rid", "<i8"), ("kh", "<i8"), ("a", "<i4"), ("olo", "<i2"), ("ohi", "<i2")])
ANCHOR = "kh bigint, rid bigint, a int, olo int, ohi int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        one = np.full(size, _BASE, np.uint64)
        two = np.full(size, _INVERSE, np.uint64)
        one[0] = two[0] = 1
        _POWERS[:] = [np.cumprod(one), np.cumprod(two)]
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(raw: bytes, length: int, gram: int) -> np.ndarray:
    """ID rows (rid 0) of the anchors of one text; none if it is shorter than ``length``."""
    n = len(raw)
    if n < length:
        return np.empty(0, ID)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * inverse[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    # rank in the upper half, and below it the place, so that the last of equals is the lowest
    low = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:have - width], low[width - have:])
    at = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    out = np.empty(len(first), ID)
    out["rid"], out["a"], out["kh"] = 0, at[first], h[at[first]].view(np.int64)
    out["olo"], out["ohi"] = at[first] - last, at[first] - first
    return out


def suffixes(raw: bytes, a: int, ohi: int, length: int, gram: int) -> tuple[bytes, bytes]:
    left = raw[a - ohi:a][::-1]
    right = raw[a:a + length]
    return b"\0" + right + b"\xff" * (length - len(right)) + left, b"\1" + raw[a:a + gram] + left


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparing."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sorted strings as common prefix with the one before, length of the rest, the rests."""
    lcp = np.zeros(len(strings), np.uint16)
    for i in range(1, len(strings)):
        lcp[i] = common(strings[i - 1], strings[i])
    tails = [s[k:] for s, k in zip(strings, lcp.tolist())]
    return lcp, np.array([len(t) for t in tails], np.uint16), b"".join(tails)


def decode(lcp: np.ndarray, size: np.ndarray, tails: bytes):
    s, at = b"", 0
    for k, n in zip(lcp.tolist(), size.tolist()):
        s = s[:k] + tails[at:at + n]
        at += n
        yield s, k


def merge_runs(runs: list):
    """Loser tree over sorted runs, each an iterator of (string, common prefix
    with the run's string before) -> (run, string, common prefix with the
    string put out before).  A contender's known prefix is that with the last
    winner: of two, the one that shares more with it is the smaller; only when
    both share equally much are bytes compared, and only from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    head: list = [next(r, (None, -1)) for r in runs] + [(None, -1)] * (k - len(runs))
    text, known = [h[0] for h in head], [0 if h[0] is not None else -1 for h in head]
    loser = [0] * k

    def winner(x: int, y: int) -> tuple[int, int]:
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        if known[x] < 0:
            return x, y
        a, b = text[x], text[y]
        n = common(a, b, known[x])
        if a[n:n + 1] <= b[n:n + 1]:
            known[y] = n
            return x, y
        known[x] = n
        return y, x

    level = list(range(k))
    at = k
    while len(level) > 1:
        at //= 2
        nxt = []
        for i in range(at):
            w, lost = winner(level[2 * i], level[2 * i + 1])
            loser[at + i] = lost
            nxt.append(w)
        level = nxt
    top = level[0]
    while text[top] is not None:
        yield top, text[top], known[top]
        s, n = next(runs[top], (None, -1))
        text[top], known[top] = s, n
        node, now = (top + k) // 2, top
        while node:
            now, loser[node] = winner(now, loser[node])
            node //= 2
        top = now


def _numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, raw) of a plain read of files.  The number is the file's,
    in the order of their names, and the row's place in it, so it is the same
    in every pass, however the pass is split."""
    spark = docs.sparkSession
    names = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # the files, not their rows
    files = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file_path string, file_no bigint")
    rows = docs.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"),
                       F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    return rows.join(F.broadcast(files), "file_path").select((F.shiftleft("file_no", 40) + F.col("row_index")).alias("rid"), "doc_id", "raw")


def _squeeze(df: DataFrame) -> DataFrame:
    """``raw`` compressed row by row, for the exchanges."""
    def f(batches):
        import zstandard
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for i in range(0, b.num_rows, 1000):  # a thousand texts at a time in memory
                part = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array([z.compress(x.as_py()) for x in part.column("raw")], pa.binary())],
                                                 names=["rid", "doc_id", "raw"])
            trim()
    return df.mapInArrow(f, "rid bigint, doc_id bigint, raw binary")


def _plain(raw: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(raw)


def _records(batch: pa.RecordBatch):
    """(rid, text, runs) of a batch's rows, runs as a dict of arrays."""
    lists = batch.column("runs")
    ends, flat = lists.offsets.to_numpy(), lists.values
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    raws = batch.column("raw")
    for i, rid in enumerate(batch.column("rid").to_numpy()):
        yield int(rid), _plain(raws[i].as_py()), {k: v[ends[i]:ends[i + 1]] for k, v in fields.items()}


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    """Integer columns, the last one binary."""
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:-1]], pa.array(cols[-1], pa.binary())], names=names)


_MARK = "rid bigint, kh bigint, a int, olo int, ohi int, tag int, m int, p1 int, q1 int, p2 int, q2 int"


def sorted_marks(texts: DataFrame, found: DataFrame, length: int, gram: int, part_bytes: int = 8_000_000,
                 run_bytes: int = 10_000_000, sample: int = 4096, most: int = 100_000) -> DataFrame:
    """The merge sort: for each anchor in ``found`` the longest match (tag 0
    to the right, tag 1 to the left) and up to two intervals of windows that
    repeat (p..q, empty if p > q).  Several rows for an anchor add up."""
    n = found.agg(F.sum(F.col("ohi") * 2 + length + gram).alias("b")).first()["b"] or 0
    parts = max(1, -(-n // part_bytes))
    sample = max(sample, min(most, 2 * parts))  # the ranges follow the bytes; at most 2 * `most` suffixes reach the driver
    picked = found.orderBy(F.xxhash64("rid", "a"), "rid", "a").limit(sample).groupBy("rid").agg(F.collect_list(F.struct("a", "ohi")).alias("runs"))

    def strings(batches):
        for batch in batches:
            for _, raw, r in _records(batch):
                for at, ohi in zip(r["a"].tolist(), r["ohi"].tolist()):
                    yield pa.RecordBatch.from_arrays([pa.array(suffixes(raw, at, ohi, length, gram), pa.binary())], names=["s"])

    few = texts.join(F.broadcast(picked), "rid").select("rid", "raw", "runs").mapInArrow(strings, "s binary")
    some = sorted({bytes(r["s"]) for r in few.collect()})  # at most 2 * sample suffixes
    splitters = some[len(some) // parts::max(1, len(some) // parts)][:parts - 1] if parts > 1 else []

    def make_runs(batches):
        import bisect
        import zstandard
        z = zstandard.ZstdCompressor(level=3)

        def flush(keys, ids):
            order = sorted(range(len(keys)), key=keys.__getitem__)
            rows = np.repeat(np.concatenate(ids), 2)
            strs, head, many, rest, whole = [], [], [], [], set()
            for i in order:  # tag 0 comes first
                if strs and keys[i] == strs[-1]:
                    many[-1] = True
                    if i not in whole:
                        rest.append(i)
                        whole.add(i + 1)  # what repeats to both sides needs no mark to the left
                else:
                    strs.append(keys[i])
                    head.append(i)
                    many.append(False)
            edges = [0, *[bisect.bisect_left(strs, s) for s in splitters], len(strs)]
            got_p, got_b = [], []
            for p, (a, b) in enumerate(zip(edges, edges[1:])):
                # members equal to a head are settled; they go along with any range
                told = rest[p::len(edges) - 1]
                if b > a or told:
                    body = (rows[head[a:b]], np.array(many[a:b], bool), front_code(strs[a:b]), rows[told],
                            np.array([keys[i][0] for i in told], np.int64))
                    got_p.append(p)
                    got_b.append(z.compress(pickle.dumps(body, protocol=5)))
            return pa.RecordBatch.from_arrays([pa.array(got_p, pa.int32()), pa.array(got_b, pa.binary())], names=["part", "block"])

        keys, ids, size = [], [], 0
        for batch in batches:
            for rid, raw, r in _records(batch):
                rows = np.empty(len(r["a"]), ID)
                rows["rid"] = rid
                for c in ("kh", "a", "olo", "ohi"):
                    rows[c] = r[c]
                ids.append(rows)
                for at, ohi in zip(r["a"].tolist(), r["ohi"].tolist()):
                    two = suffixes(raw, at, ohi, length, gram)
                    keys += two
                    size += len(two[0]) + len(two[1])
                if size >= run_bytes:
                    yield flush(keys, ids)
                    keys, ids, size = [], [], 0
        if keys:
            yield flush(keys, ids)
            keys, ids = [], []
        trim()

    by_doc = found.groupBy("rid").agg(F.collect_list(F.struct("a", "olo", "ohi", "kh")).alias("runs"))
    blocks = texts.join(by_doc, "rid").select("rid", "raw", "runs").mapInArrow(make_runs, "part int, block binary")

    def merge(group: pa.Table) -> pa.Table:
        import zstandard
        z = zstandard.ZstdDecompressor()
        bodies = [pickle.loads(z.decompress(b.as_py())) for b in group.column("block")]
        marks = Marks(length, gram)
        for _, _, _, rows, tags in bodies:
            marks.settled(rows, tags)
        cursor = [0] * len(bodies)
        for run, s, n in merge_runs([decode(*b[2]) for b in bodies]):
            i = cursor[run]
            cursor[run] += 1
            marks.put(bodies[run][0][i], s, n, bool(bodies[run][1][i]))
        out = marks.table(group.column("part")[0].as_py())
        trim()
        return out

    merged = save(blocks.groupBy("part").applyInArrow(merge, f"{_MARK}, part int, edge int, s binary"), "suffix-marks")
    first, last = merged.where("edge = 1"), merged.where("edge = 2")  # a row for each range

    def meet(batches):
        for batch in batches:
            for x in batch.to_pylist():
                marks = Marks(length, gram)
                for k in ("l_", "f_"):
                    row = np.zeros((), ID)
                    for c in ID.names:
                        row[c] = x[k + c]
                    s = bytes(x[k + "s"])
                    marks.put(row, s, common(marks.before, s) if marks.before else 0, False)
                yield marks.table(0).select(_MARK_COLUMNS).combine_chunks().to_batches()[0]

    prefix = lambda df, p: df.select((F.col("part") + int(p == "l_")).alias("part"), *[F.col(c).alias(p + c) for c in [*ID.names, "s"]])
    seams = prefix(last, "l_").join(prefix(first, "f_"), "part").mapInArrow(meet, _MARK)
    return merged.where("edge = 0").select(*_MARK_COLUMNS).unionByName(seams)


_MARK_COLUMNS = [x.split()[0] for x in _MARK.split(", ")]


class Marks:
    """Takes the suffixes of a range in order and keeps what each learns from its two neighbours."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.before, self.rows, self.told = length, gram, None, [], []
        self.first = None

    def settled(self, rows: np.ndarray, tags: np.ndarray) -> None:
        one, zero = np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
        m = np.where(tags == 0, self.length, rows["ohi"])
        self.told.append(np.stack([*(rows[c].astype(np.int64) for c in ID.names), tags, m, rows["olo"].astype(np.int64), rows["ohi"].astype(np.int64), one, zero], 1))

    def put(self, row, s: bytes, n: int, many: bool) -> None:
        rid, kh, a, olo, ohi = row.item()
        tag = s[0]
        now = [rid, kh, a, olo, ohi, tag, 0, 1, 0, 1, 0]
        if many:
            now[6:9] = [self.length if tag == 0 else ohi, olo, ohi]
        if self.before is not None and self.before[0] == tag and n > 0:
            old, n = self.rows[-1], n - 1
            if tag == 1:
                m = n - self.gram
                if m >= 0:
                    old[6], now[6] = max(old[6], m), max(now[6], m)
            elif n >= self.gram:
                right = min(n, self.length)
                left = n - self.length
                if left < 0:
                    left = 0
                    if self.length - right <= max(ohi, old[4]):
                        left = common(self.before[1 + self.length:], s[1 + self.length:])
                elif s[self.length] == 255:  # both texts end there
                    right = len(s[1:1 + self.length].rstrip(b"\xff"))
                for x, free in ((old, 9), (now, 7 if not many else 9)):
                    x[6] = max(x[6], right)
                    p, q = max(x[3], self.length - right), min(x[4], left)
                    if p <= q:
                        x[free:free + 2] = [p, q]
        self.before = s
        if self.first is None:
            self.first = (now, s)
        self.last = (now, s)
        self.rows.append(now)

    def table(self, part: int) -> pa.Table:
        """A row for each mark (edge 0), and the first and the last with their suffixes (edge 1, 2)."""
        marks = np.concatenate([np.array(self.rows, np.int64).reshape(-1, 11), *self.told])
        ends = [(*self.first, 1), (*self.last, 2)] if self.first else []
        marks = np.concatenate([marks, np.array([r for r, _, _ in ends], np.int64).reshape(-1, 11)])
        n = len(marks) - len(ends)
        cols = [pa.array(marks[:, i]).cast(pa.int64() if i < 2 else pa.int32()) for i in range(11)]
        cols += [pa.array(np.full(len(marks), part, np.int32)), pa.array(np.array([0] * n + [e for _, _, e in ends], np.int32)),
                 pa.array([None] * n + [s for _, s, _ in ends], pa.binary())]
        return pa.Table.from_arrays(cols, names=[*_MARK_COLUMNS, "part", "edge", "s"])


def hot_keys(counted: DataFrame, share: int = 1000) -> DataFrame:
    """The keys ``kh`` that hold more than 1/``share`` of all ``n`` rows: fewer than ``share`` of them."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where(F.col("n") * share > total).select("kh")


def join_hot(rows: DataFrame, per_key: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` joined to the one row of its key; the few hot keys are joined where their rows stand."""
    few = F.broadcast(hot)
    return rows.join(few, "kh", "left_anti").join(per_key.join(few, "kh", "left_anti"), "kh") \
        .unionByName(rows.join(F.broadcast(per_key.join(few, "kh", "left_semi")), "kh"))


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 64, plain_read: bool = False) -> tuple[DataFrame, DataFrame]:
    """(numbered texts, spans): spans (rid, s, e) cover every byte of every
    ``length``-byte string that starts at two places or more.  Unless ``docs``
    is a ``plain_read`` of files, it is written first, so that all passes see
    the same rows in the same places."""
    texts = _numbered(docs if plain_read else save(docs.select("doc_id", "text"), "suffix-input"))

    def find(batches):
        for b in batches:
            got = []
            texts_of = b.column("raw")
            for i, rid in enumerate(b.column("rid").to_pylist()):
                rows = anchors(texts_of[i].as_py(), length, gram)
                rows["rid"] = rid
                got.append(rows)
            rows = np.concatenate(got) if got else np.empty(0, ID)
            yield pa.RecordBatch.from_arrays([pa.array(rows["kh"]), pa.array(rows["rid"]), *[pa.array(rows[c].astype(np.int32)) for c in ("a", "olo", "ohi")]],
                                             names=["kh", "rid", "a", "olo", "ohi"])
            del texts_of, got, rows
            trim()
        _POWERS.clear()
        trim()

    every = save(texts.select("rid", "raw").mapInArrow(find, ANCHOR), "suffix-anchors")
    again = save(every.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1"), "suffix-again")
    hot = hot_keys(again)
    found = save(join_hot(every, again.select("kh"), hot).select(*every.columns), "suffix-found")
    squeezed = _squeeze(texts)
    marks = sorted_marks(squeezed, found, length, gram)
    per = marks.groupBy("rid", "kh", "a", "olo", "ohi").agg(
        F.max(F.when(F.col("tag") == 0, F.col("m"))).alias("right"), F.max(F.when(F.col("tag") == 1, F.col("m"))).alias("left"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("tag") == 0, F.filter(
            F.array(F.struct(F.col("p1").alias("p"), F.col("q1").alias("q")), F.struct(F.col("p2").alias("p"), F.col("q2").alias("q"))),
            lambda x: x["p"] <= x["q"]))))).alias("sure"))
    lo, hi = F.greatest("olo", length - F.col("right")), F.least("ohi", "left")
    # windows lo..hi may repeat; past the sure ones that begin without a gap, the rest is open
    reach = lambda: F.aggregate("sure", F.col("lo") - 1, lambda r, x: F.when(x["p"] <= r + 1, F.greatest(r, x["q"])).otherwise(r))
    per = save(per.withColumn("lo", lo).withColumn("hi", hi).withColumn("open", reach() + 1), "suffix-decided")
    sure = per.select("rid", "a", F.explode("sure").alias("x")).select("rid", (F.col("a") - F.col("x.q")).alias("s"), (F.col("a") - F.col("x.p") + length).alias("e"))
    opened = per.where("open <= hi").select("rid", "a", "kh", "open", "hi")
    need = opened.groupBy("kh").agg(F.min("open").alias("n_lo"), F.max("hi").alias("n_hi"))
    ask = join_hot(found, need, hot).join(opened.select("rid", "a", "open", "hi"), ["rid", "a"], "left") \
        .select("rid", "a", F.greatest("olo", "n_lo").alias("w_lo"), F.least("ohi", "n_hi").alias("w_hi"),
                F.coalesce("open", F.lit(1)).alias("o_lo"), F.coalesce("hi", F.lit(0)).alias("o_hi")) \
        .where("w_lo <= w_hi").groupBy("rid").agg(F.collect_list(F.struct("a", "w_lo", "w_hi", "o_lo", "o_hi")).alias("runs"))

    def windows(batches):
        import xxhash
        for batch in batches:
            for rid, raw, r in _records(batch):
                view = memoryview(raw)
                at = [(a - o, p <= o <= q) for a, lo, hi, p, q in zip(*(r[c].tolist() for c in ("a", "w_lo", "w_hi", "o_lo", "o_hi"))) for o in range(lo, hi + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(view[i:i + length]) for i, _ in at], pa.binary()), pa.array(np.full(len(at), rid)),
                                                  pa.array([i for i, _ in at], pa.int32()), pa.array([w for _, w in at], pa.bool_())], names=["h", "rid", "s", "wanted"])
        trim()

    open_windows = squeezed.join(ask, "rid").select("rid", "raw", "runs").mapInArrow(windows, "h binary, rid bigint, s int, wanted boolean")
    exact = save(open_windows, "suffix-open")
    # all windows are counted, before the shuffle too; only the open ones ask for the answer
    twice = exact.groupBy("h").agg(F.count("*").alias("n"), F.max("wanted").alias("w")).where("n > 1 and w").select("h")
    more = exact.where("wanted").join(twice, "h").select("rid", "s", (F.col("s") + length).alias("e"))
    return texts, sure.unionByName(more)


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64, plain_read: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept):
    each whole text without the bytes of strings of ``length`` bytes that also
    start anywhere else, in the same text or another; ``kept`` is binary.

    Texts are UTF-8 bytes and judged as they came in; a null text counts as
    empty; texts shorter than ``length`` stay whole; repeated rows are
    different documents, so both lose what they share; null ids are kept; an
    empty table gives no rows; other columns are ignored.
    """
    texts, spans = repeated_spans(docs, length, gram, plain_read)
    by_doc = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))

    def cut(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        for batch in batches:
            out, size = [], 0
            lists, raws = batch.column("cuts"), batch.column("raw")
            ends, flat = lists.offsets.to_numpy(), lists.values
            at_s, at_e = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                raw = _plain(raws[i].as_py())
                order = np.argsort(at_s[ends[i]:ends[i + 1]], kind="stable")
                starts, reach = at_s[ends[i]:ends[i + 1]][order], np.maximum.accumulate(at_e[ends[i]:ends[i + 1]][order])
                new = np.flatnonzero(starts[1:] > reach[:-1]) + 1 if len(order) else order
                first = starts[np.concatenate([[0], new])] if len(order) else starts
                last = reach[np.concatenate([new - 1, [len(order) - 1]])] if len(order) else reach
                gone, n = int((last - first).sum()), len(first)
                kept = [raw[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), len(raw)])]
                out.append((doc, len(raw), gone, n, b"".join(kept)))
                size += len(raw)
                if size > 4_000_000:
                    yield _batch(out, names)
                    out, size = [], 0
            yield _batch(out, names)
        trim()

    return _squeeze(texts).join(by_doc, "rid", "left").select("doc_id", "raw", "cuts") \
        .mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
