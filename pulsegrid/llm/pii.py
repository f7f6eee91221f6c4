"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Native throughout. Base spans (email, ip, card, phone) are seeds. The words before and after a seed are
lexical patterns. Identifier-like tokens outside all seeds are candidates with patterns of their own. In
the bipartite graph of patterns and instances (distinct values), a pattern's score for a kind is the
smoothed mean confidence of its instances, and a candidate's confidence is the mean score of its patterns;
a few rounds of joins spread them. Candidates that reach ``CONFIDENCE`` through patterns with at least
``SUPPORT`` distinct seeds become spans of that kind. Only aggregated edges take part in the rounds, so a
frequent word is one row per instance, summed before any shuffle.

Defined results: null text is the empty text and has no span; repeated rows agree; spans belong to an id and a text
together, so rows with a null or repeated id get, and lose by redaction, those of their own text; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop_saved, keyed, save
from pulsegrid.llm.spans import bound, free, hits, listed, prefix, ranked, where

KINDS = ("email", "ip", "card", "phone")
_ROW = ("doc_id", "_k", "_t")
CONFIDENCE, SUPPORT, ROUNDS, SMOOTHING = 0.8, 5, 3, 1.0
#: A private-use character stands for a separator inside a match, so that patterns stay flat: nested
#: repetition would recurse once per separator and overflow on long lists of numbers.
_MARK, _OTHER = "\ue000", "\ue001"
_LOCAL = f"A-Za-z0-9._%+{_MARK}-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = f"[0-9][0-9{_MARK}]+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"(?<!\S)(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){7})\S++"
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    d = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(d, i, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def _kept(kind: str, h: Column) -> Column:
    v = h["value"]
    n = F.length(_digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(_OCTET))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(v)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda h: _kept(kind, h)


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, _k, _t, the base hits of each kind with context, and the candidates outside them."""
    t = keyed(docs.select("doc_id", "text")).select("doc_id", "_k", "_t", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = t.withColumn("_u", F.translate("t", _MARK, _OTHER))
    digit = F.col("t").rlike("[0-9]")
    at = F.instr("t", "@") > 0
    joined_mail = F.regexp_replace("_u", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)
    joined_card = F.regexp_replace("_u", r"(?<=[0-9])[ -](?=[0-9])", _MARK)
    out = t.select(
        *_ROW,
        where(at, hits(joined_mail, _EMAIL)).alias("email"),
        where(F.col("t").rlike(r"[0-9]\.[0-9]"), hits(F.col("t"), _IP)).alias("ip"),
        where(digit & F.col("t").rlike(r"[0-9](?:[ -]?[0-9]){13}"), hits(joined_card, _CARD)).alias("card"),
        where(F.col("t").rlike(r"\+[0-9]"), hits(F.col("t"), _PHONE)).alias("phone"),
        where(digit | at, hits(F.col("t"), _TOKEN)).alias("tokens"),
    )
    out = out.select(*_ROW, *[F.filter(k, _keeps(k)).alias(k) for k in KINDS], "tokens")
    taken = F.concat(*[F.transform(k, lambda h: F.struct(h["start"].alias("s"), h["end"].alias("e"))) for k in KINDS])
    out = out.withColumn("_taken", taken)

    def identifier(h: Column) -> Column:
        return (F.length(_digits(h["value"])) >= 7) | (F.instr(h["value"], "@") > 1)

    def trimmed(h: Column) -> Column:
        lead = F.length(F.regexp_extract(h["value"], r"^[^0-9A-Za-z+]*", 0))
        core = F.regexp_replace(h["value"], r"^[^0-9A-Za-z+]*|[^0-9A-Za-z]*$", "")
        start = h["start"] + lead
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), h["before"].alias("before"), h["after"].alias("after"))

    cores = F.filter(F.transform(F.filter("tokens", identifier), trimmed), lambda h: h["end"] > h["start"])
    return out.select(*_ROW, *KINDS, free(cores, F.col("_taken")).alias("candidates"))


def _patterns(h: Column) -> Column:
    """Lexical patterns of an occurrence: one and two words before it, one word after it."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    left, right = F.split(F.rtrim(flat(h["before"])), r"\s+"), F.split(F.ltrim(flat(h["after"])), r"\s+")
    n = F.size(left)
    one = F.concat(F.lit("L1 "), F.element_at(left, -1))
    two = F.when(n >= 3, F.concat_ws(" ", F.lit("L2"), F.element_at(left, n - 1), F.element_at(left, -1)))
    after = F.when(F.size(right) >= 2, F.concat(F.lit("R1 "), F.element_at(right, 1)))
    return F.array_compact(F.array(F.when(n >= 2, one), two, after))


def occurrences(base: DataFrame) -> DataFrame:
    """One row per seed or candidate occurrence: _k, _t, kind (null for candidates), place, value, patterns."""

    def tagged(column: str, kind: str | None) -> Column:
        return F.transform(column, lambda h: F.struct(F.lit(kind).cast("string").alias("kind"), h["start"].alias("start"), h["end"].alias("end"), F.lower(h["value"]).alias("value"), _patterns(h).alias("patterns")))

    return base.select("_k", "_t", F.explode(F.concat(*[tagged(k, k) for k in KINDS], tagged("candidates", None))).alias("o")).select("_k", "_t", "o.*")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, score, support from distinct (pattern, value, kind) edges; kind null marks candidates."""
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("seed"))
    size = edges.groupBy("pattern").agg(F.count("*").cast("double").alias("size"))
    # Only candidates whose patterns have seeds can be believed. A frequent context may have very many candidates: they are summed
    # per value before they are shuffled, and Spark splits its rows in the join.
    first = seeds.join(size.hint("merge"), "pattern").select("pattern", "kind", (F.col("seed") / (F.col("size") + SMOOTHING)).alias("score"), F.col("seed").alias("support"))
    scores = save(first, "scores")
    free = save(edges.where("kind IS NULL").select("pattern", "value").join(scores.select("pattern").distinct().hint("merge"), "pattern", "left_semi"), "free")
    if free.isEmpty():
        return scores
    base = save(seeds.join(size.hint("merge"), "pattern"), "seeds")
    for _ in range(rounds):
        believed = free.join(scores.hint("merge"), "pattern").groupBy("value", "kind").agg(F.avg("score").alias("belief"))
        given = free.join(believed.hint("merge"), "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("given"))
        before, scores = scores, save(
            base.join(given.hint("merge"), ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("seed") + F.coalesce("given", F.lit(0.0))) / (F.col("size") + SMOOTHING)).alias("score"), F.col("seed").alias("support")),
            "scores",
        )
        drop_saved(before)
    drop_saved(free)
    drop_saved(base)
    return scores


def personal_data(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """doc_id, _k, _t, ``base`` and ``added``: arrays of (start, rank, end, kind)."""
    base = save(find_base(docs), "base")
    seen = save(occurrences(base), "occurrences")
    edges = save(seen.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct(), "edges")
    strong = score_patterns(edges).where((F.col("score") >= confidence) & (F.col("support") >= support))
    drop_saved(edges)
    loose = seen.where("kind IS NULL").select("_k", "_t", "start", "end", F.explode("patterns").alias("pattern"))
    best = loose.join(strong.hint("merge"), "pattern").groupBy("_k", "_t", "start", "end", "kind").agg(F.max("score").alias("score")).groupBy("_k", "_t", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = best.groupBy("_k", "_t").agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind")).alias("added"))
    spans = base.select(*_ROW, F.concat(*[ranked(F.col(k), k, i) for i, k in enumerate(KINDS)]).alias("base"))
    none = F.expr("CAST(array() AS array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")
    return spans.join(added.hint("merge"), ["_k", "_t"], "left").select(*_ROW, "base", F.coalesce("added", none).alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, ``n_chars`` adjusted.

    Of overlapping spans the one that starts first, or the longer of two, decides the kind; none of
    their characters stays.
    """
    found = personal_data(docs).select("_k", "_t", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("_s"))
    found = found.where(F.size("_s") > 0).dropDuplicates(["_k", "_t"])
    t = F.col("text")

    # What stays lies between spans: pieces from the largest end so far to the next start, joined once.
    ends = bound(prefix(F.transform("_s", lambda s: s["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b)), lambda e: F.concat(F.array(F.lit(0).cast("long")), e))
    cut = lambda at, n: F.substring(t, (at + 1).cast("int"), n.cast("int"))

    def pieces(e: Column) -> Column:
        piece = lambda s, i: F.when(s["start"] < F.element_at(e, i + 1), F.lit("")).otherwise(F.concat(cut(F.element_at(e, i + 1), s["start"] - F.element_at(e, i + 1)), F.lit("<"), s["kind"], F.lit(">")))
        return F.concat(F.array_join(F.transform("_s", piece), ""), bound(F.element_at(e, -1), lambda last: cut(last, F.length(t))))

    clean = bound(ends, pieces)
    out = keyed(docs).join(found.hint("merge"), ["_k", "_t"], "left").withColumn("text", F.when(F.col("_s").isNull(), t).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_s").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The operator's spans as counts, a digest of the base spans, and the list of all spans."""
    found = personal_data(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
