"""Secret scans with multipart credential linking, in SQL expressions only.

Strong kinds (assign, access, hex) are reported wherever they stand.  Weak
candidates are parts that mean nothing alone: a bare mixed token that may be
a secret, an endpoint, a short access identifier, a user name.  Parts and
the character scopes around them are interval-joined; a weak candidate is
reported only if a complementary part starts within its scope.

Spans are counted in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import text_key, unused

# The base patterns (kind, pattern, least code points of `group`).
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: a shorter run holds no later match either
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 or more, likewise
# Parts of a credential that count only together with another.
WEAK = {
    # '=' may stand before a run (NAME=run) and pad its end; a run with '=' and a value behind it is the value's name.  No
    # upper length: the runs are possessive, so a long one is passed once.
    "w_secret": r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}+(?!=["']?[A-Za-z0-9+/_-])={0,2}+""",
    "w_endpoint": r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@/?&=%~-]{4,}",
    "w_user": r"(?i:(?:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?)[A-Za-z0-9_.@-]{3,}",
    "w_access": r"\b(?:ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,}|\bAKIA[A-Z0-9]{6,11}(?![A-Z0-9])",
}
# Which part a kind stands for, and the parts that make it whole.
PART = {"assign": "secret", "access": "id", "hex": "secret", "w_secret": "secret", "w_endpoint": "endpoint", "w_user": "id", "w_access": "id"}
NEEDS = {"w_secret": ("id", "endpoint"), "w_endpoint": ("secret",), "w_user": ("secret",), "w_access": ("secret",)}
KINDS = ["assign", "access", "hex", "w_secret", "w_endpoint", "w_user", "w_access"]


def matches(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<s, k, e, v>> of all leftmost non-overlapping matches: what
    stands between the matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found,
                      lambda b, m: F.struct(F.char_length(b).alias("b"), F.char_length(m).alias("n"), m.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,v:string>>").alias("out"))

    def step(acc, x):
        s = acc["at"] + x["b"]
        one = F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("k"), (s + x["n"]).alias("e"), x["v"].alias("v"))
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """The strong spans, by start, then kind."""
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    assign = F.when(F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")),
                    F.filter(matches(text, "assign", ASSIGN),
                             lambda m: F.char_length(F.regexp_extract(m["v"], ASSIGN, 1)) >= 8)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), matches(text, "access", ACCESS)).otherwise(none)
    hexes = F.when(text.rlike(HEX), matches(text, "hex", HEX)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def weak_spans(text: Column) -> Column:
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    gate = {"w_secret": text.rlike("[A-Za-z0-9+/_-]{20}"), "w_endpoint": F.contains(text, F.lit("://")),
            "w_user": F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")),
            "w_access": text.rlike("ASIA|AGPA|AIDA|AROA|AKIA")}
    return F.concat(*[F.when(gate[k], matches(text, k, p)).otherwise(none) for k, p in WEAK.items()])


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, text_key, base, spans), one row for
    each row; ``base`` holds the strong spans and ``spans`` those and the
    linked weak ones, as array<struct<s, k, e>> with k an index into KINDS.

    Two parts are linked if their starts are fewer than ``scope`` code points
    apart.  Each cell of that width holds the first and the last start of its
    parts of a kind, so a part meets three cells, not other parts.  A weak part that
    overlaps a strong span is not reported.  A null text counts as empty and
    has no spans; rows that share id and text have the same spans; null ids
    are kept; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = lambda a: F.transform(a, lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))
    found = docs.select("doc_id", text_key().alias("text_key"), plain(base_spans(text)).alias("base"), plain(weak_spans(text)).alias("weak"))
    loose = F.filter("weak", lambda w: ~F.exists("base", lambda b: (w["s"] < b["e"]) & (b["s"] < w["e"])))
    # a text without a weak part, or with a single part, links nothing: it sends no row
    parts = found.select("doc_id", "text_key", "base", loose.alias("weak")).where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)) \
        .select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("m"))
    part_of = F.element_at(F.array(*[F.lit(PART[k]) for k in KINDS]), F.col("m.k") + 1)
    placed = parts.select("doc_id", "text_key", "m", part_of.alias("part"), F.expr(f"m.s div {scope}").alias("cell"))
    # the parts of a cell as first and last starts: combined before the shuffle, never as pairs
    ends = [f(F.when(F.col("part") == p, F.col("m.s"))).alias(f"{n}_{p}") for p in ("secret", "id", "endpoint") for n, f in (("first", F.min), ("last", F.max))]
    held = placed.groupBy("doc_id", "text_key", "cell").agg(*ends)
    weak = placed.where(F.col("m.k") >= 3).select("doc_id", "text_key", "m", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell"))
    s = F.col("i.m.s")
    # the nearest start of a kind in a cell before, in the same one or in the one behind
    near = lambda p: F.coalesce((F.abs(s - F.col(f"h.first_{p}")) < scope) | (F.abs(s - F.col(f"h.last_{p}")) < scope), F.lit(False))
    whole = F.lit(False)
    for kind, needs in NEEDS.items():
        any_need = F.lit(False)
        for p in needs:
            any_need = any_need | near(p)
        whole = whole | ((F.col("i.m.k") == KINDS.index(kind)) & any_need)
    i, h = weak.alias("i"), held.alias("h")
    linked = i.join(h, F.col("i.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("i.text_key") == F.col("h.text_key"))
                    & (F.col("i.cell") == F.col("h.cell"))).where(whole) \
        .groupBy(F.col("i.doc_id").alias("l_doc"), F.col("i.text_key").alias("l_key")) \
        .agg(F.collect_set("i.m").alias("linked"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return found.join(linked, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("text_key") == F.col("l_key")), "left") \
        .select("doc_id", "text_key", "base", F.array_sort(F.concat("base", F.coalesce("linked", none))).alias("spans"))


def span_text(spans: Column) -> Column:
    kind = lambda m: F.element_at(F.array(*[F.lit(k) for k in KINDS]), m["k"] + 1)
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", kind(m), m["s"].cast("string"), m["e"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = 400) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; all
    rows and columns stay (``n_chars``, if there, follows the new text).
    Overlapping spans become one mark; a null text stays null."""
    k, i, key, s = unused(docs, "_k", "_id", "_key", "_spans")
    spans = scan(docs, scope).where(F.size("spans") > 0).select(F.col("doc_id").alias(i), F.col("text_key").alias(key), F.col("spans").alias(s)) \
        .groupBy(i, key).agg(F.first(s).alias(s))  # rows that share id and text have equal spans
    joined = docs.withColumn(k, text_key()).join(spans, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(k) == F.col(key)), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        gap = F.col("text").substr(acc["at"] + 1, m["s"] - acc["at"])
        return F.when(m["s"] >= acc["at"], F.struct(m["e"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))) \
            .otherwise(F.struct(F.greatest(acc["at"], m["e"]).alias("at"), acc["out"].alias("out")))

    text = F.aggregate(s, start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    new = F.when(F.col(s).isNotNull(), text).otherwise(F.col("text"))
    out = joined.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(s).isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
