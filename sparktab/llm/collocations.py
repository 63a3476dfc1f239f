"""Phrase collocation mining with HAT-trie counts.

Texts are tokenised once, into chunks: the different words of a few texts, and
the chunk's text as places in that list.  Phrases are counted a length at a
time.  A task keeps its counts in a trie of word ids whose leaves are hash
containers: a container holds the rest of its phrases as one packed number,
and bursts into a node of containers by the next word when it grows.  When the
trie holds too many phrases, its largest subtrees (all phrases with one first
word) leave as sorted runs, one row for each prefix (the first word, of longer
phrases the first two); rows are shuffled by prefix, and each prefix partition
is merged.  Prefixes that are common in the whole corpus are split in
``LANES`` by the next word.  A phrase is counted only if its first and its
last words but one are among the frequent phrases one word shorter, as a Bloom
filter of fixed size has them: no frequent phrase can be lost, a false hit is
counted in vain.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.llm.common import save, trim

ID_BITS = 21  # of a word id in a task; the ids start anew when they run out
BURST = 8192  # phrases of a container before it bursts
HELD = 600_000  # phrases of a task's trie before it spills
RUN = 50_000  # phrases of a run at least, unless the trie ends
HOT = 256  # prefixes that are split in LANES: any other has less than 1/HOT of all
LANES = 64
FILTER_BITS = 1 << 26  # of the Bloom filter, whatever the input: 8 MB
PIECE = 2 << 20  # bytes of text in a chunk, which holds under a million different words
BREAK = b"\xff"  # no UTF-8 text holds it

_CUTS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0xFF if c in _CUTS else 0x20 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def tokens(raw: bytes):
    """Lower-cased words and ``BREAK`` between pieces, lists of about ``PIECE`` bytes at a time."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and raw[end] not in b" \t":
            end += 1
        yield raw[at:end].translate(_TABLE).replace(BREAK, b" \xff ").split(b" ")
        at = end


def mix64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word)


class Node:
    """A trie node: word id -> Node, or a Counter of the packed rest of the phrases."""

    __slots__ = ("kids", "rest", "limit")

    def __init__(self, rest: int, limit: int):
        self.kids: dict[int, object] = {}
        self.rest = rest  # words of a phrase below the kids
        self.limit = limit  # phrases of a container before it bursts

    def add(self, first: np.ndarray, packed: np.ndarray) -> int:
        """Count phrases by first word and packed rest; returns how many are new."""
        new = 0
        order = np.argsort(first, kind="stable")
        first, packed = first[order], packed[order]
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else []
        for a, z in zip(at, [*at[1:], len(first)]):
            w = int(first[a])
            kid = self.kids.get(w)
            if kid is None:
                kid = self.kids[w] = Counter()
            if isinstance(kid, Node):
                new += kid.add_packed(packed[a:z])
                continue
            before = len(kid)
            kid.update(packed[a:z].tolist())
            new += len(kid) - before
            if len(kid) > self.limit and self.rest > 1:
                self.kids[w] = burst(kid, self.rest, self.limit)
        return new

    def add_packed(self, packed: np.ndarray) -> int:
        shift = np.int64(ID_BITS * self.rest)
        return self.add(packed >> shift, packed & ((np.int64(1) << shift) - 1))


def burst(held: Counter, words: int, limit: int) -> Node:
    """A container of phrases with ``words`` words left as a node of smaller ones."""
    node = Node(words - 1, limit)
    shift = ID_BITS * node.rest
    for key, n in held.items():
        kid = node.kids.get(key >> shift)
        if kid is None:
            kid = node.kids[key >> shift] = Counter()
        kid[key & ((1 << shift) - 1)] = n
    return node


def packed_of(kid, rest: int, head: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(packed rest, count) arrays of all containers below a trie entry with ``rest`` words left."""
    if isinstance(kid, Node):
        return [x for w, below in kid.kids.items() for x in packed_of(below, kid.rest, head + (w << ID_BITS * kid.rest))]
    return [(np.fromiter(kid.keys(), np.int64, len(kid)) + np.int64(head), np.fromiter(kid.values(), np.int64, len(kid)))]


def size_of(kid) -> int:
    return sum(size_of(k) for k in kid.kids.values()) if isinstance(kid, Node) else len(kid)


class Words(dict):
    """Word -> place in ``words``, given at first sight."""

    def __init__(self, *first: bytes):
        super().__init__(zip(first, range(len(first))))
        self.words = [*first]

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        return at


class Trie:
    """Counts of the phrases of ``length`` words of one language in one task."""

    def __init__(self, lang: str, length: int, known: np.ndarray, limit: int, hot: list[str] = ()):
        self.lang, self.length, self.known, self.limit = lang, length, known, limit
        self.hot = [p.encode().split(b" ") for p in hot]
        self.reset()

    def reset(self):
        """Forget words and counts (after everything has spilled)."""
        self.ids = Words(BREAK)
        self.root = Node(self.length - 1, self.limit)
        self.held = 0

    def add(self, words: list[bytes], hashes: np.ndarray, ids: np.ndarray, seen: int) -> None:
        """Count the phrases of a chunk whose last word is at ``seen`` or later:
        ``ids`` are places in ``words`` and ``hashes``, 0 a break."""
        k, n = self.length, len(ids) - self.length + 1
        if n <= 0:
            return
        h, ok = hashes[ids], ids > 0
        table = h
        for j in range(1, k - 1):  # hash of the k - 1 words from each place
            h, ok = mix64(h[:-1], table[j:]), ok[:-1] & (ids[j:] > 0)
        slot = h & np.uint64(FILTER_BITS - 1)
        ok &= (self.known[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(ok[:n] & ok[1:n + 1])
        at = at[at + k - 1 >= seen]
        if not len(at):
            return
        used = np.zeros(len(words), bool)
        for j in range(k):
            used[ids[at + j]] = True
        own = np.zeros(len(words), np.int64)
        used = np.flatnonzero(used)
        own[used] = [self.ids[words[i]] for i in used.tolist()]
        packed = np.zeros(len(at), np.int64)
        for j in range(1, k):
            packed = packed << np.int64(ID_BITS) | own[ids[at + j]]
        self.held += self.root.add(own[ids[at]], packed)

    def spill(self, keep: int):
        """Sorted runs (phrases, counts) of the largest subtrees until ``keep`` phrases are left; small subtrees share a run."""
        if self.held <= keep:
            return
        rank = np.empty(len(self.ids.words), np.int64)
        rank[sorted(range(len(rank)), key=self.ids.words.__getitem__)] = np.arange(len(rank))
        lane = np.array([crc32(w) % LANES for w in self.ids.words], np.int64)
        going, rows = [], 0
        for size, w in sorted(((size_of(kid), w) for w, kid in self.root.kids.items()), reverse=True):
            if self.held <= keep:
                break
            going.append((w, self.root.kids.pop(w)))
            self.held -= size
            rows += size
            if rows >= RUN:
                yield self.run(going, rank, lane)
                going, rows = [], 0
        if going:
            yield self.run(going, rank, lane)

    def run(self, subtrees: list, rank: np.ndarray, lane: np.ndarray) -> pa.RecordBatch:
        """One row (lang, prefix, lane, rests, n) for each prefix, in the order of the words."""
        first, packed, n = [], [], []
        for w, kid in subtrees:
            for p, c in packed_of(kid, self.length - 1):
                first.append(np.full(len(p), w, np.int64))
                packed.append(p)
                n.append(c)
        packed, mask, depth = np.concatenate(packed), np.int64((1 << ID_BITS) - 1), min(2, self.length - 1)
        cols = [np.concatenate(first), *[packed >> np.int64(ID_BITS * i) & mask for i in range(self.length - 2, -1, -1)]]
        head = cols[0] if depth == 1 else cols[0] << np.int64(ID_BITS) | cols[1]
        known = [[self.ids.get(w) for w in p] for p in self.hot if all(w in self.ids for w in p)]
        hot = np.isin(head, [p[0] if depth == 1 else p[0] << ID_BITS | p[1] for p in known])
        lane = np.where(hot, lane[cols[depth]], 0)
        order = np.lexsort([*[rank[c] for c in reversed(cols[depth:])], lane, *[rank[c] for c in reversed(cols[:depth])]])
        head, lane, cols = head[order], lane[order], [c[order] for c in cols]
        start = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (lane[1:] != lane[:-1])]))
        words, ends = pa.array(self.ids.words, pa.binary()), pa.array(np.append(start, len(head)).astype(np.int32))
        join = lambda cs: pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in cs], b" ")
        rests = pc.binary_join(pa.ListArray.from_arrays(ends, join(cols[depth:])), b"\n")
        n = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(n)[order].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(start), pa.string()), join([c[start] for c in cols[:depth]]).cast(pa.string()),
                                           pa.array(lane[start].astype(np.int32)), rests.cast(pa.string()), n], ["lang", "prefix", "lane", "rests", "n"])


def bloom(frequent: DataFrame) -> np.ndarray:
    """The fixed-size bit set of the frequent phrases (lang, phrase) of one
    length; at most FILTER_BITS / 64 rows reach the driver."""
    def slots(batches):
        for pdf in batches:
            out = []
            for lang, phrase in zip(pdf["lang"], pdf["phrase"]):
                h = np.array([word_hash(lang, w) for w in phrase.encode().split(b" ")], np.uint64)
                x = h[:1]
                for j in range(1, len(h)):
                    x = mix64(x, h[j:j + 1])
                out.append(int(x[0]) & FILTER_BITS - 1)
            s = np.array(out, np.int64)
            yield pd.DataFrame({"slot": s >> 6, "bits": (np.uint64(1) << (s & 63).astype(np.uint64)).view(np.int64)})

    rows = frequent.select("lang", "phrase").mapInPandas(slots, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[rows["slot"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8)


_CHUNK = "lang string, words binary, hashes binary, ids binary, seen int"


def chunks(docs: DataFrame, longest: int) -> DataFrame:
    """``docs`` (lang, text bytes) -> rows (lang, words, hashes, ids, seen): about
    ``PIECE`` bytes of one language's texts each, as places (0: a break) in the
    list of the chunk's words; the first ``seen`` places were already in the
    chunk before (``longest`` - 1 of them, where a long text is cut)."""
    def encode(batches):
        held: dict[str, tuple[list[bytes], int]] = {}

        def out(lang, raw):
            last: list[bytes] = []
            for found in tokens(raw):
                found = [*last, *filter(None, found)]
                place = Words(BREAK)
                ids = np.fromiter(map(place.__getitem__, found), np.int32, len(found))
                hashes = np.array([0, *(word_hash(lang, w) for w in place.words[1:])], np.uint64)
                yield pa.RecordBatch.from_pylist([{"lang": lang, "words": b" ".join(place.words), "hashes": hashes.tobytes(), "ids": ids.tobytes(), "seen": len(last)}],
                                                 pa.schema([("lang", pa.string()), ("words", pa.binary()), ("hashes", pa.binary()), ("ids", pa.binary()), ("seen", pa.int32())]))
                last = found[-(longest - 1):]

        for batch in batches:
            for lang, raw in zip(batch["lang"].to_pylist(), batch["text"]):
                texts, size = held.get(lang, ([], 0))
                texts.append(raw.as_py())
                held[lang] = texts, size + len(texts[-1])
                if held[lang][1] >= PIECE:
                    yield from out(lang, (b" \xff ").join(texts))
                    held[lang] = [], 0
        while held:
            lang, (texts, _) = held.popitem()
            yield from out(lang, (b" \xff ").join(texts))
        trim()

    return docs.mapInArrow(encode, _CHUNK)


def read_chunks(batches):
    """(lang, words, hashes, ids, seen) of each chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, words, seen = (batch[c][i].as_py() for c in ("lang", "words", "seen"))
            hashes, ids = (batch[c][i].as_buffer() for c in ("hashes", "ids"))
            yield lang, words.split(b" "), np.frombuffer(hashes, np.uint64), np.frombuffer(ids, np.int32), seen


def counted(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "a"])


def word_counts(encoded: DataFrame, held_words: int = HELD // 2) -> DataFrame:
    """Chunks -> (lang, phrase, a): the words."""
    def count(batches):
        held: dict[str, dict[bytes, int]] = {}

        def out():
            for lang, c in held.items():
                yield counted(lang, pa.array(list(c), pa.binary()), np.fromiter(c.values(), np.int64, len(c)))

        for lang, words, _, ids, seen in read_chunks(batches):
            c = held.setdefault(lang, {})
            n = np.bincount(ids[seen:], minlength=len(words))
            for i in (np.flatnonzero(n[1:]) + 1).tolist():
                c[words[i]] = c.get(words[i], 0) + int(n[i])
            if sum(map(len, held.values())) > held_words:
                yield from out()
                held = {}
                trim()
        yield from out()
        held = {}
        trim()

    return encoded.mapInArrow(count, "lang string, phrase string, a bigint").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def phrase_counts(encoded: DataFrame, length: int, known: np.ndarray, hot: dict[str, list[str]], held: int = HELD, limit: int = BURST) -> DataFrame:
    """Chunks -> (lang, phrase, a): the phrases of ``length`` words whose
    beginning and end are in the filter ``known``; ``hot`` names the common prefixes of each lang."""
    shared = encoded.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        tries: dict[str, Trie] = {}
        read = 0

        def out(trie, keep):
            yield from trie.spill(keep)
            if not trie.held:
                trie.reset()
            trim()

        for lang, words, hashes, ids, seen in read_chunks(batches):
            trie = tries.setdefault(lang, Trie(lang, length, shared.value, limit, hot.get(lang, ())))
            if len(trie.ids) + len(words) > 1 << ID_BITS:
                yield from out(trie, 0)
            trie.add(words, hashes, ids, seen)
            read += len(ids)
            if read >= 1 << 30:  # a run's counts are 32-bit numbers
                for t in tries.values():
                    yield from out(t, 0)
                read = 0
            while (total := sum(t.held for t in tries.values())) > held:
                big = max(tries.values(), key=lambda t: t.held)
                yield from out(big, max(0, min(big.held - (total - held), held // 2)))
        while tries:
            yield from out(tries.popitem()[1], 0)
        trim()

    runs = encoded.mapInArrow(count, "lang string, prefix string, lane int, rests string, n array<int>")
    # the merge: every prefix partition adds up the runs' counts phrase by phrase
    pairs = runs.repartition("lang", "prefix", "lane").select("lang", "prefix", "lane", F.inline(F.arrays_zip(F.split("rests", "\n").alias("rest"), F.col("n").alias("n"))))
    return pairs.groupBy("lang", "prefix", "lane", "rest").agg(F.sum("n").alias("a")).select("lang", F.concat_ws(" ", "prefix", "rest").alias("phrase"), "a")


def common(counts: DataFrame) -> dict[str, list[str]]:
    """The HOT most frequent of (lang, phrase, a), by lang."""
    out: dict[str, list[str]] = {}
    for r in counts.orderBy(F.desc("a"), "lang", "phrase").limit(HOT).collect():
        out.setdefault(r["lang"], []).append(r["phrase"])
    return out


def mine(docs: DataFrame, least: int = 30, longest: int = 4, inside: int = 80, top: int = 2000,
         held: int = HELD, limit: int = BURST) -> DataFrame:
    """``docs`` (lang, text) -> the first ``top`` collocations of each language:
    (lang, rank, phrase, a, l, r, n, score).

    A candidate has 2 to ``longest`` words and occurs ``least`` times; its
    score is that of its weakest cut; one that lies inside a longer candidate
    with ``inside`` per cent of its count goes.  A task's trie spills at
    ``held`` phrases, a container bursts at ``limit``.  A null lang is ``und``; null
    and empty texts have no words; ties go by count, then by phrase; repeated
    rows count each time; an empty table gives no rows; other columns are
    ignored.
    """
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    encoded = save(chunks(d, longest), "col-chunks")
    words = save(word_counts(encoded), "col-words")
    levels = [words.where(F.col("a") >= least)]
    for k in range(2, longest + 1):
        hot = common(levels[min(k, 3) - 2])
        levels.append(save(phrase_counts(encoded, k, bloom(levels[-1]), hot, held, limit).where(F.col("a") >= least).withColumn("k", F.lit(k)), f"col-{k}"))
    counts = levels[0].select("lang", "phrase", "a")
    candidates = levels[1]
    for c in levels[2:]:
        candidates = candidates.unionByName(c)
    counts = counts.unionByName(candidates.select("lang", "phrase", "a"))
    scored = weakest_cut(candidates, counts)
    parts = candidates.where("k > 2").withColumn("w", F.split("phrase", " ")).select(
        "lang", F.col("a").alias("longer"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("a").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def floor_score(a: Column, both: Column) -> Column:
    wide = F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", wide, both.cast("decimal(38,0)")).cast("bigint")


def weakest_cut(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the lowest-scoring cut, the earliest of equals."""
    cut = candidates.withColumn("w", F.split("phrase", " ")).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1))) \
        .select("lang", "phrase", "a", "at", F.array_join(F.slice("w", F.lit(1), F.col("at")), " ").alias("first"),
                F.array_join(F.slice("w", F.col("at") + 1, F.col("k") - F.col("at")), " ").alias("rest"))
    l = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    r = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scores = cut.join(l, ["lang", "first"]).join(r, ["lang", "rest"]).withColumn("score", floor_score(F.col("a"), F.col("l") + F.col("r")))
    return scores.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("m")) \
        .select("lang", "phrase", "a", "m.l", "m.r", "m.score")
