"""Empty tasks, long texts, null keys, distances and clashing names."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparktab.llm import chat, decontam, edit_fingerprint, quality, secret_scan, suffix_dedup, toxicity
from sparktab.llm.common import frame, unused
from test_llm import brute_repeats

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_frame_keeps_types():
    d = frame(a=([], object), b=([], "int64"), c=([], float))
    assert [str(t) for t in d.dtypes] == ["object", "int64", "float64"]


def test_toxicity_empty_tasks(spark, docs, labels):
    """Far more tasks than rows in some, tasks and batches without a hit."""
    few = docs.where("doc_id < 150").repartition(211)
    got = toxicity.score_documents(few, labels).select("doc_id", "_score").collect()
    assert len(got) == few.count() and all(0 <= r._score <= 1 for r in got)
    one = docs.join(labels.where("toxic = 1").limit(1), "doc_id").unionByName(docs.join(labels.where("toxic = 0").limit(1), "doc_id")).repartition(7)
    assert toxicity.score_documents(one.select("doc_id", "text"), labels).count() == one.count()


def test_lexicon_by_substrings(spark, docs, labels):
    """Hits equal a plain search for every entry at every place."""
    lexicon, exceptions = toxicity.learn_lexicon(toxicity.training_rows(docs, labels, "toxic", 20_000))
    assert lexicon
    weights = dict(lexicon)
    matcher = toxicity.automaton(weights, exceptions)
    for r in docs.limit(200).collect():
        t = toxicity.fold(r.text)
        spans = [(a, a + len(p)) for p in exceptions for a in range(len(t)) if t.startswith(p, a)]
        best = {}
        for e, w in lexicon:
            for a in (i for i in range(len(t)) if t.startswith(e, i)):
                if not any(x <= a < z - 1 for x, z in spans):
                    best[a] = max(w, best.get(a, w))
        assert abs(toxicity.evidence(matcher, t)[0] - sum(best.values())) < 1e-9


def test_fingerprints_of_texts_longer_than_a_slice(spark):
    rng = random.Random(2)
    texts = ["x" * 5000, "", "".join(rng.choice("abc ") for _ in range(3000)), "short", None, "y" * 1200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for parts in (1, 3):
        got = sorted(map(tuple, edit_fingerprint.compare_edited(df.repartition(parts), slice_chars=1000).collect()))
        t = [x or "" for x in texts]
        want = edit_fingerprint._compare(list(range(6)), t, t[1:] + t[:1])
        assert got == sorted(map(tuple, want.astype(object).values.tolist()))


def test_near_duplicates_recall(spark, docs):
    """Planted texts with 1 per cent of their characters replaced, against the pairs that really are that near."""
    rng = random.Random(6)
    rows = []
    for r in docs.where("length(text) between 600 and 4000").limit(60).collect():
        t = list(r.text)
        for i in rng.sample(range(len(t)), len(t) // 100):
            t[i] = rng.choice("etaoin ")
        rows += [(2 * len(rows), r.text), (2 * len(rows) + 1, "".join(t))]
    rows = list({t: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame([(2 * (k // 2) + k % 2, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    fps = [edit_fingerprint.fingerprints([t])[0] for _, t in rows]
    near = [k for k in range(0, len(rows) - 1, 2) if edit_fingerprint.likeness(fps[k][None], fps[k + 1][None])[0] >= 0.8]
    group = {r.doc_id: r.group_id for r in edit_fingerprint.near_duplicates(df).collect()}
    assert len(near) > 20 and np.mean([group[k] == group[k + 1] for k in near]) >= 0.9


def test_suffix_dedup_real_documents(spark, docs):
    rows = docs.where("doc_id < 120").select("doc_id", "text").collect()
    more = [(10_000, "hot line " * 300 + "x"), (10_001, "hot line " * 300 + "y"), (10_002, "q" * 30_000)]
    rows = [(r.doc_id, r.text) for r in rows] + more
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 400).collect()}
    want = dict(zip([i for i, _ in rows], brute_repeats([t for _, t in rows], 400)))
    assert got == want and sum(x[1] > 0 for x in want.values()) > 5


def test_suffix_query_planted_passages(spark, tmp_path):
    """The registered query on files: passages of over 50 words go if 400 bytes or more repeat, and stay if it is 399; clean documents stay whole."""
    from sparktab.llm.queries import QUERIES
    rng = random.Random(21)
    words = lambda n: " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 5))) for _ in range(n))

    def passage(size):
        text = words(200).encode()[:size - 1].decode(errors="ignore")
        return text + "." * (size - len(text.encode()))

    long, short = [passage(400), passage(900)], [passage(399), passage(350)]
    plant = lambda p, i: f"{words(60)} {chr(65 + i)}{p}{chr(65 + i)} {words(40)}"
    rows = [(i, plant((long + short)[i % 4], i)) for i in range(24)] + [(i, words(120)) for i in range(24, 60)]
    assert all(len(p.split()) > 50 for p in long + short)
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    want = brute_repeats([t for _, t in rows], 400)
    for (i, text), (size, gone, spans, kept) in zip(rows, want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_kept) == (size, gone, spans, hashlib.sha256(kept).hexdigest(), len(kept))
        cut = long[i % 4] if i < 24 and i % 4 < 2 else ""  # other letters stand around it in each document
        assert r.text == text.replace(cut, "") and gone == len(cut.encode()) and spans == bool(cut)


def test_hot_keys_lose_nothing(spark):
    rows = spark.createDataFrame([(k, i) for k in range(40) for i in range(300 if k < 2 else 1 + k % 3)], "kh bigint, rid bigint")
    counted = rows.groupBy("kh").count().withColumnRenamed("count", "n").where("n > 1")
    hot = suffix_dedup.hot_keys(counted, 4)
    assert {r.kh for r in hot.collect()} == {0, 1}
    joined = suffix_dedup.join_hot(rows, counted, hot)
    assert Counter(map(tuple, joined.select("kh", "rid", "n").collect())) == Counter(map(tuple, rows.join(counted, "kh").select("kh", "rid", "n").collect()))


def test_chat_null_conversation_over_many_tasks(spark):
    rows = [(None, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(2000)] + [(1, i, "user", "x") for i in range(50)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(d)).collect()}
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:2000]).encode()).hexdigest()
    assert got[None].n_turns == 2000 and got[None].turns_sha256 == want and got[1].n_turns == 50


def test_secret_links_by_distance(spark):
    """Two parts are linked wherever they stand, if they start fewer than 400 code points apart."""
    secret = "Zx9abcdefghijklmnopqrstuv"
    rows, want = [], {}
    for lead in (0, 40, 95, 105, 150, 190, 199, 230, 399, 401):
        for apart in (60, 300, 399, 400, 700):
            for first, second in (("user: bob", secret), (secret, "user: bob")):
                k = len(rows)
                rows.append((k, "." * lead + first + " " + "." * (apart - len(first) - 2) + " " + second, "k", 1))
                want[k] = apart < 400
    d = spark.createDataFrame(rows, "doc_id bigint, text string, _k string, cell int")
    got = {r.doc_id: len(r.spans) == 2 for r in secret_scan.scan(d).collect()}
    assert got == want
    out = secret_scan.redact(d)
    assert out.columns == d.columns and {r._k for r in out.collect()} == {"k"}


def test_clashing_names(spark, docs, labels):
    import corpus_pipeline as P
    d = docs.where("doc_id < 300").selectExpr("*", "doc_id * 0.5 as _score", "'mine' as _held_out", "'a' as _k", "'b' as _id", "'c' as _key", "'p' as _place")
    kept = P.quality_stage(spark, d, SF)
    assert kept.columns == d.columns and all(r._score == r.doc_id * 0.5 and r._held_out == "mine" for r in kept.collect())
    for out in (P.near_dedup_stage(spark, d, SF), P.decontaminate_stage(spark, d, SF), P.secrets_stage(spark, d, SF)):
        assert out.columns == d.columns and {(r._k, r._id, r._key, r._place) for r in out.collect()} == {("a", "b", "c", "p")}
    assert unused(d, "_K", "new") == ["_K_", "new"]


def test_packing_words_met_before_are_not_encoded_again(monkeypatch):
    """150,000 different words are in the cache when they come again; ids are the plain tokenizer's."""
    import numpy as np
    import pyarrow as pa
    from sparktab.llm import packing
    from sparktab.llm.queries import tokenizer_path
    tok = packing.WordTokenizer(tokenizer_path())
    odd = ["İstanbul ΣΑΣ. ΟΔΟΣ, ﬁne ǅ ß İ. a.b, . , .. ., x., 12. naïve,", "", "A.\tB,\r\nC ẞ. Å. ª"]
    for text, raw in zip(odd * 2, tok.texts(pa.array(odd * 2, pa.large_string()))):
        assert np.frombuffer(raw, "<u4").tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids
    text = pa.array([" ".join(f"w{i}" for i in range(150_000))], pa.large_string())
    first = [*tok.texts(text)]
    seen = []
    encode = tok._encode
    monkeypatch.setattr(tok, "_encode", lambda words: seen.extend(words) or encode(words))
    assert [*tok.texts(text)] == first and not seen
