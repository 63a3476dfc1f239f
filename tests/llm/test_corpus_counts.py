"""Divergence audit, collocations and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparktab.llm import collocations, divergence, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, p string, block string, id string"  # clashing extra columns


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(320)]
    out = []
    for i in range(420):
        n = rng.choice([0, 3, 40, 90])
        text = " ".join(vocab[min(319, int(rng.expovariate(0.02)))] + rng.choice(["", "", ".", " New York City", "; Ab ab ab"]) for _ in range(n))
        out.append((i, text, rng.choice(["en", "en", "en", "de"]), rng.choice(["s1", "s1", "s1", "s2", "s3", "é4", "s10", None]), 5, "x", "y", "z"))
    long = " ".join(rng.choice(vocab) for _ in range(60_000))
    out += [(500, None, None, None, 1, None, None, None), (501, "", "fr", "only", 1, "", "", ""), (501, "", "fr", "only", 1, "", "", ""), (502, " \n\t.,", "fr", "other", 1, "", "", ""),
            (503, "ab " * 5000, None, "s1", 1, "", "", ""), (None, "new york city", "en", "s2", 1, "", "", ""), (None, "new york city", "en", "s2", 1, "", "", ""), (504, long, "en", "s1", 1, "", "", "")]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def brute_audit(rows, least, top):
    count, df = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, t, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
        count[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    for lang, source in groups:
        keep = [t for t, n in df[lang].items() if n >= least]
        p = {}
        total = Counter()
        for g in groups:
            if g[0] == lang:
                c = {t: count[g][t] for t in keep}
                total.update(c)
                p[g[1]] = {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(keep)) for t, n in c.items()}
        q = {t: 1 + 10**9 * (total[t] + 5) // (sum(total.values()) + 5 * len(keep)) for t in keep}
        mine = p[source]
        pairs = sorted(((-sum(abs(mine[t] - p[s][t]) for t in keep), s.encode(), s) for s in p if s != source))
        out |= {(lang, source, "pair", s, -v, i) for i, (v, _, s) in enumerate(pairs, 1)}
        terms = sorted((-(mine[t] - q[t]), t.encode(), t) for t in keep if count[lang, source][t] and mine[t] > q[t])
        out |= {(lang, source, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:top], 1)}
    return out


def test_divergence(spark, rows, frame, monkeypatch):
    want = brute_audit(rows, 30, 50)
    assert {r[2] for r in want} == {"pair", "term"} and len(want) > 100
    assert Counter(map(tuple, divergence.audit(frame).collect())) == Counter(want)
    monkeypatch.setattr(divergence, "SOURCES", 2)  # several slices of sources
    assert Counter(map(tuple, divergence.audit(frame, 3, 7).collect())) == Counter(brute_audit(rows, 3, 7))
    assert divergence.audit(frame.limit(0)).count() == 0


def test_divergence_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    n, total, v = 3 * 10**17, 8 * 10**17, 10**9
    d = spark.createDataFrame([(n, total, v)], "n bigint, total bigint, v bigint")
    assert d.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


def brute_collocations(rows, least, top, inside=80):
    f = defaultdict(Counter)
    for _, t, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i:i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= inside * cand[p[i:i + m]]}
        ranked = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), " ".join(p), c[p[:k]], c[p[k:]]))
        n = sum(a for p, a in c.items() if len(p) == 1)
        out |= {(lang, i, p, -a, l, r, n, -s) for i, (s, a, _, p, l, r) in enumerate(sorted(ranked)[:top], 1)}
    return out


def test_collocations(rows, frame):
    want = brute_collocations(rows, 30, 2000)
    assert len(want) > 20 and {r[0] for r in want} >= {"en", "und"}
    assert set(map(tuple, collocations.mine(frame).collect())) == want
    # small tries: containers burst, subtrees spill many times; ranks are cut
    small = collocations.mine(frame, least=3, top=40, held=200, limit=8).collect()
    assert Counter(map(tuple, small)) == Counter(brute_collocations(rows, 3, 40))
    assert collocations.mine(frame.limit(0)).count() == 0


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(collocations, "RUN", 5)
    rng = np.random.default_rng(1)
    every = np.full(collocations.FILTER_BITS // 8, 255, np.uint8)
    trie = collocations.Trie("en", 4, every, 4, ["a b", "c c", "not here"])
    words = [collocations.BREAK, b"a", b"b", b"c"]
    want, got = Counter(), Counter()
    lanes: dict[str, set] = {}

    def take(run):
        rows = run.to_pylist()
        assert [r["prefix"].split() for r in rows] == sorted(r["prefix"].split() for r in rows)
        for r in rows:
            rests = r["rests"].split("\n")
            assert rests == sorted(rests, key=str.split) and len(rests) == len(r["n"])
            lanes.setdefault(r["prefix"], set()).add(r["lane"])
            got.update({f"{r['prefix']} {x}".encode(): n for x, n in zip(rests, r["n"])})

    for _ in range(30):
        ids = rng.integers(0, 4, 200).astype(np.int32)
        found = [words[i] for i in ids]
        trie.add(words, np.arange(4, dtype=np.uint64), ids, 0)
        want.update(b" ".join(t) for i in range(197) if collocations.BREAK not in (t := tuple(found[i:i + 4])))
        left = set(trie.root.kids)
        for run in trie.spill(40):
            take(run)
        # what a subtree held has gone as a whole or not at all
        assert trie.held == sum(map(collocations.size_of, trie.root.kids.values())) and set(trie.root.kids) <= left
    assert any(isinstance(k, collocations.Node) for k in trie.root.kids.values())
    for run in trie.spill(0):
        take(run)
    assert got == want and trie.held == 0 and len(lanes["a b"]) > 1 and lanes["b a"] == {0}


def test_collocation_text_slices(spark, monkeypatch):
    raw = ("Ab c.d " * 50 + "é\tf!").encode()
    whole = [w for part in collocations.tokens(raw) for w in part if w]
    with monkeypatch.context() as m:
        m.setattr(collocations, "PIECE", 7)
        assert [w for part in collocations.tokens(raw) for w in part if w] == whole and whole[:4] == [b"ab", b"c", b"\xff", b"d"]
    # a text of several chunks: the words before the cut are read again, not counted again
    rng = random.Random(8)
    text = " ".join(rng.choice("abcdefgh") * 6 for _ in range(400_000))
    df = spark.createDataFrame([(1, text, "en", "s", 1, "", "", "")], SCHEMA)
    docs = df.selectExpr("lang", "cast(text as binary) text")
    seen = [r.seen for r in collocations.chunks(docs, 4).select("seen").collect()]
    assert seen == [0, 3]
    got = collocations.mine(df, least=30, top=10**6).collect()
    assert set(map(tuple, got)) == brute_collocations([(1, text, "en")], 30, 10**6)


def brute_targets(rows, share, most):
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, goal = share * sum(size.values()), set(names), {}
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > most * size[s]}
        if not over:
            goal |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
            break
        for s in over:
            goal[s] = most * size[s]
        left -= sum(goal[s] for s in over)
        free -= over
    return size, goal


def test_mixing(rows, frame, monkeypatch):
    size, goal = brute_targets(rows, 1.5, 2)
    plans = []
    for bucket_rows in (100_000, 7):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
        mixed = mixing.mix(frame).toPandas()
        at = mixed["position"].dropna()
        assert at.is_monotonic_increasing and at.between(0, 1).all()
        taken = mixed.assign(s=[x if isinstance(x, str) else None for x in mixed["source"]]).groupby("s", dropna=False)["words"].sum()
        for s, g in goal.items():
            mine = mixed[mixed["source"].isna() if s is None else mixed["source"] == s]
            assert mine["words"].sum() == int(g) and (abs(mine["target"] - g) < 1e-6 * max(1, g)).all() and (mine["source_size"] == size[s]).all()
        assert len(taken) == len(goal)
        per = mixing.per_document(mixing.mix(frame.repartition(3))).collect()
        assert Counter((r.doc_id, r.size) for r in per) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows)
        assert all(0 <= r.taken <= 2 * r.size for r in per)
        plans.append(Counter((r.doc_id, r.size, r.taken, r.first_position) for r in per))
    assert plans[0] == plans[1]
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mix(frame.where("doc_id = 501")).toPandas()["words"].sum() == 0


def test_mixing_order_in_a_source(rows, frame):
    key = lambda i, t: hashlib.md5((str(i) if i is not None else t or "").encode()).hexdigest()
    text = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): t for i, t, *_ in rows}
    mixed = mixing.mix(frame).where("source = 's2' and words > 0 and epoch = 0").toPandas()
    keys = [key(None if i != i else int(i), text[None if i != i else int(i), n]) for i, n in zip(mixed["doc_id"], mixed["size"])]
    assert keys == sorted(keys) and len(keys) > 20


def test_schedules(spark):
    from pyspark.sql import functions as F
    share = [i / 50 for i in range(51)]
    d = spark.createDataFrame([(s,) for s in share], "s double")
    for schedule in (*mixing.CURRICULUM, ((0, 0), (0.3, 0), (0.6, 5), (1, 0))):
        t = np.array([r[0] for r in d.select(mixing.due(schedule, F.col("s"))).collect()])
        fine = np.linspace(0, 1, 200_001)
        w = np.interp(fine, [k for k, _ in schedule], [v for _, v in schedule])
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.abs(np.interp(t, fine, area / area[-1]) - share).max() < 1e-6
    assert [mixing.integrals(s)[-1] for s in mixing.CURRICULUM] == [3, 1, 2]
    for bad in (((0, 1), (0, 1)), ((0, 0), (1, 0)), ((0, -1), (1, 3))):
        with pytest.raises(ValueError):
            mixing.integrals(bad)
