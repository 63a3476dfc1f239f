"""Registered queries of this package: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm import (chat, collocations, decontam, divergence, edit_fingerprint, license_scan, mixing, packing, quality, secret_scan, simhash,
                          suffix_dedup, toxicity)
from sparktab.llm.common import save, table


def tokenizer_path() -> str:
    """The vocabulary file op2 packs with; pass another path to ``packing``."""
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 4096)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "licences", "n_licence", F.round("best", 3).alias("best"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3)
    return d.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400, plain_read=True)
    # beside the contract's columns, what is left: bytes, and text (a character cut in two shows as U+FFFD)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                    (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secret_scan.scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda m: m["k"] == k)).cast("bigint")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                    F.sha2(secret_scan.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_words").alias("item_words"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.per_document(save(mixing.mix(table(spark, sf_dir, "documents")), "mix-order"))
    return d.withColumn("first_permille", F.floor(1000 * F.col("first_position")).cast("bigint")).drop("first_position")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_license_scan, op4_simhash_near_dedup, op5_suffix_array_dedup,
                            op6_chat_formatting, op7_secret_scan, op8_benchmark_decontamination, op9_quality_classifier, op10_document_fingerprints,
                            op11_source_divergence, op12_phrase_collocations, op13_source_mixing)}

_TURNS = """SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
    keep AS (SELECT lang, term, count(*) AS qn FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    l AS (SELECT lang, count(*) AS v, sum(qn) AS lt FROM keep GROUP BY lang),
    gt AS (SELECT lang, source, term, count(*) AS n FROM t JOIN keep USING (lang, term) GROUP BY lang, source, term),
    s AS (SELECT lang, source, sum(n) AS total FROM gt GROUP BY lang, source),
    g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lt, 0) AS lt, coalesce(total, 0) AS total
        FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN s USING (lang, source)),
    p AS (SELECT g.lang, g.source, k.term, coalesce(gt.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(gt.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
        1 + (1000000000::HUGEINT * (k.qn + 5)) // (g.lt + 5 * g.v) AS q
        FROM g JOIN keep k ON g.lang = k.lang LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source AND gt.term = k.term),
    f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
        AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
    a AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a) WHERE part = 'pair' OR rank <= 50"""

_COLLOCATIONS = rf"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    w AS (SELECT lang, id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w1 FROM (SELECT *, row_number() OVER () AS id FROM p)),
    n AS (SELECT lang, w1, w1 || ' ' || lead(w1) OVER o AS w2, w1 || ' ' || lead(w1) OVER o || ' ' || lead(w1, 2) OVER o AS w3,
        w1 || ' ' || lead(w1) OVER o || ' ' || lead(w1, 2) OVER o || ' ' || lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
    f AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM n GROUP BY lang, w1
        UNION ALL SELECT lang, 2, w2, count(*) FROM n WHERE w2 IS NOT NULL GROUP BY lang, w2
        UNION ALL SELECT lang, 3, w3, count(*) FROM n WHERE w3 IS NOT NULL GROUP BY lang, w3
        UNION ALL SELECT lang, 4, w4, count(*) FROM n WHERE w4 IS NOT NULL GROUP BY lang, w4),
    c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 30),
    cuts AS (SELECT *, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:k], ' ') AS y FROM c, (VALUES (1), (2), (3)) AS js(j) WHERE j < k),
    s AS (SELECT cuts.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score FROM cuts
        JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS n FROM s) WHERE n = 1),
    z AS (SELECT lang, phrase, a, l, r, score FROM b WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = b.lang AND o.k > b.k AND 100 * o.a >= 80 * b.a
        AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
    JOIN (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000"""

_MIXING = r"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h FROM documents),
    g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS kind FROM s GROUP BY source),
    w AS (SELECT *, CAST([3, 1, 2][kind + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS top FROM g),
    o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS pot, sum(w) OVER (ORDER BY top / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
        coalesce(sum(top) OVER (ORDER BY top / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w),
    r AS (SELECT *, top <= (pot - gone) * w / free AS stopped FROM o),
    t AS (SELECT source, source_size, kind, CASE WHEN stopped THEN top ELSE (pot - coalesce(sum(top) FILTER (stopped) OVER (), 0)) * w / sum(w) FILTER (NOT stopped) OVER () END AS target
        FROM r),
    c AS (SELECT s.doc_id, s.size, t.source_size, t.kind, t.target, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
    k AS (SELECT *, greatest(0, least(size, floor(target) - begun)) AS one, greatest(0, least(size, floor(target) - begun - source_size)) AS two,
        CASE WHEN target > 0 THEN begun / target * [3.0, 1.0, 2.0][kind + 1] END AS due FROM c),
    x AS (SELECT *, CASE kind WHEN 0 THEN CASE WHEN due < 1.875 THEN 4.5 ELSE 3 END WHEN 1 THEN 0.5 ELSE 2 END AS w0,
        CASE kind WHEN 0 THEN CASE WHEN due < 1.875 THEN due ELSE due - 1.875 END WHEN 1 THEN CASE WHEN due < 0.25 THEN due ELSE due - 0.25 END ELSE due END AS rest,
        CASE kind WHEN 0 THEN -3 WHEN 1 THEN CASE WHEN due < 0.25 THEN 0 ELSE 4 END ELSE 0 END AS slope,
        CASE WHEN kind = 0 AND due >= 1.875 OR kind = 1 AND due >= 0.25 THEN 0.5 ELSE 0 END AS t0 FROM k)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(one + two AS BIGINT) AS taken, CAST((one > 0)::INT + (two > 0)::INT AS BIGINT) AS copies,
        CASE WHEN one > 0 THEN CAST(floor(1000 * (t0 + 2 * rest / (w0 + sqrt(greatest(0, w0 * w0 + 2 * slope * rest))))) AS BIGINT) END AS first_permille FROM x"""

ORACLE_SQL: dict[str, str] = {
    "op11_source_divergence": _DIVERGENCE, "op12_phrase_collocations": _COLLOCATIONS, "op13_source_mixing": _MIXING,
    # a benchmark item whose words stand in a document one after the other; near-verbatim overlaps are tested by brute force
    "op6_chat_formatting": f"""WITH t AS ({_TURNS}),
    f AS (SELECT *, regexp_replace(text, '([\\\\\\[\\]<>])', '\\\\\\1', 'g') AS body, regexp_replace(role, '([\\\\\\[\\]<>])', '\\\\\\1', 'g') AS name FROM t),
    z AS (SELECT *, length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 16 + length(name) END AS size FROM f),
    u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM z)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
        CAST(sum(size) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE role = 'assistant') AS n_examples,
        CAST(sum(CASE WHEN role = 'assistant' THEN upto ELSE 0 END) AS BIGINT) AS example_chars
    FROM u GROUP BY conv_id""",
}
