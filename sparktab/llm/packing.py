"""Best-fit packing of token sequences by hierarchical residual packing.

Every task packs the pieces of its own partition by best fit, largest first,
and emits the bins that are full or nearly so.  The underfull bins go up a
tree: the bins of ``fan`` neighbouring nodes meet in one task as items for
another round of best fit, and so on until one node is left or a round joins
nothing.  Only the pieces' numbers travel, never their tokens.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import save, trim

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_TOKENIZERS: dict = {}
CACHED_WORDS = 300_000  # memory bound of a worker's word cache (about 60 MB), not of its words


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of ``ids`` up to each of ``ends``."""
    raw, ends = ids.tobytes(), (4 * ends).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    White space always ends a word for this kind of tokenizer, so a text's ids
    are its words' ids in order, and a word met before needs no new encoding.
    Words are cut at blanks and line breaks only; what else is in one, other
    kinds of white space too, is the tokenizer's business.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> list[bytes]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return _cut(np.array([i for ids in found for i in ids], "<u4"), np.cumsum([len(ids) for ids in found], dtype=np.int64))

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, many in one call: each ends with its only end-of-word token."""
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            part = words[i:i + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):  # a letter that lower-casing or composing takes apart
                out += self._encode(part)
            else:
                out += _cut(ids, cut)
        return out

    def _values(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, none of them empty unless it is in the cache."""
        cache = self.cache
        out = [cache.get(w) for w in words]
        core: list[tuple[int, str, str]] = []  # (place, word without its mark, mark) of each word not met before
        letters, rest = set(), {",", "."} - cache.keys()
        for i, known in enumerate(out):
            if known is not None:
                continue
            w = words[i]
            mark = w[-1]
            if (mark == "." or mark == ",") and len(w) > 1 and w[:-1].isalpha():
                k, alpha = w[:-1], True
            else:
                k, mark, alpha = w, "", w.isalpha()
            if alpha:
                if k.isascii():
                    k = k.lower()
                else:
                    k = k.replace("Σ", "σ").lower()  # letter by letter: no final sigma
                    if not k.isalpha():  # a letter that lower-casing takes apart: its accent and a mark are one piece
                        k, mark, alpha = w, "", False
            core.append((i, k, mark))
            if k not in cache:
                (letters if alpha else rest).add(k)
        if not core:
            return out
        new = dict(zip(order := [*letters], self._encode_letters(order))) | dict(zip(order := [*rest], self._encode(order)))
        value = lambda k: new[k] if k in new else cache[k]
        marks = {"": b"", ",": value(","), ".": value(".")}
        for i, k, mark in core:
            v = new[k] if k in new else cache[k]
            out[i] = v + marks[mark] if mark else v
        room = CACHED_WORDS - len(cache)
        if room > 0:
            new.update((words[i], out[i]) for i, _, _ in core)
            cache.update(itertools.islice(new.items(), room))
        return out

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        blank = texts
        for c in ("\n", "\r", "\t"):
            blank = pc.replace_substring(blank, c, " ")
        words = pc.split_pattern(blank, " ")
        coded = pc.dictionary_encode(words.values)
        values = np.empty(len(coded.dictionary), object)
        values[:] = self._values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        index, at = coded.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
        for a, b in zip(at[:-1], at[1:]):
            yield b"".join(values[index[a:b]])


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:  # kept for the worker's life
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def in_slices(batches, column: str, most_bytes: int = 8_000_000):
    """(batch, texts) in slices of about ``most_bytes`` of text, one row at least; null is empty."""
    for batch in batches:
        t = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(t).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most_bytes)))
            yield batch.slice(at, upto - at), t.slice(at, upto - at)
            at = upto


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1) -> DataFrame:
    """Tokenised documents in pieces of at most ``capacity`` ids: (doc_id,
    piece, start, length, ids_crc32).  A document's ids end with ``end_id``;
    a null text counts as empty, so it is one piece of that id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        tok = tokenizer(path)
        for batch, texts in in_slices(batches, "text"):
            rows: list = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), tok.texts(texts)):
                ids = memoryview(raw + end)
                for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a:a + 4 * capacity]
                    rows.append((doc, p, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(cut, PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: (bin of each item, its offset there, fill of each bin).
    A bit for each residual that some bin has gives the tightest bin that fits."""
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = open_by[r].pop()
            if not open_by[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if r - s:
            open_by[r - s].append(b)
            mask |= 1 << (r - s)
    return where, offset, np.array(fill, np.int64)


def pack(items: DataFrame, capacity: int = 4096, fan: int = 16, spare: int = 16) -> DataFrame:
    """``items`` with a ``length`` of 1 to ``capacity`` -> the same rows with
    ``sequence_id`` and ``offset``.

    Bins with at most ``spare`` places left are emitted where they arise; the
    others are merged up the tree.  Ties go to the earlier row; an empty table
    gives no rows; lengths outside the range raise an error.
    """
    spark, columns = items.sparkSession, items.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    schema = f"{fields}, sequence_id bigint, offset bigint, fill bigint, node bigint"

    def local(batches):
        import pyspark
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        node = pyspark.TaskContext.get().partitionId()
        t = pa.Table.from_batches(rows)
        size = t.column("length").to_numpy()
        if size.min() < 1 or size.max() > capacity:
            raise ValueError(f"lengths must be 1 to {capacity}")
        bins, offset, fill = best_fit(size, capacity)
        t = t.append_column("sequence_id", pa.array(bins + (np.int64(node) << 32)))
        t = t.append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill[bins]))
        yield from t.append_column("node", pa.array(np.full(len(size), node, np.int64))).to_batches()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Bins of one node's children as items: a joined bin takes the id of its first part."""
        parts = pdf[["sequence_id", "fill"]].drop_duplicates("sequence_id").sort_values("sequence_id")
        bins, offset, fill = best_fit(parts["fill"].to_numpy(), capacity)
        first = parts.groupby(bins)["sequence_id"].min().to_numpy()
        at = parts["sequence_id"].searchsorted(pdf["sequence_id"])
        return pdf.assign(offset=pdf["offset"] + offset[at], sequence_id=first[bins][at], fill=fill[bins][at])

    done, level = [], save(items.mapInArrow(local, schema), "pack-0")
    left = F.col("fill") < capacity - spare
    nodes = (level.agg(F.max("node")).first()[0] or 0) + 1
    tree = 0
    while nodes > 1:
        nodes, tree = -(-nodes // fan), tree + 1
        done.append(level.where(~left))
        up = level.where(left).withColumn("node", F.expr(f"node div {fan}"))
        before = up.agg(F.count_distinct("sequence_id")).first()[0]
        level = save(up.groupBy("node").applyInPandas(merge, schema), f"pack-{tree}")
        if level.agg(F.count_distinct("sequence_id")).first()[0] > 0.999 * before and nodes > 1:
            break  # nothing fits together any more
    for part in done:
        level = level.unionByName(part)
    return level.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """Tokenise and pack whole documents (doc_id, text): see ``pieces`` and
    ``pack``.  Repeated rows are packed as often as they come, null ids keep
    their place, other columns are ignored."""
    return pack(pieces(docs, path, capacity), capacity)
