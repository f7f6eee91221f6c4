"""Secret scans: base patterns, and multipart credentials linked within a scope.

Native throughout. Base spans (assign, access, hex) always stand. Weak candidates (a login name given as an
assignment, an endpoint, an opaque mixed-class token) say little alone; an interval join reports them
only where parts that complete a credential lie within ``SCOPE`` code points: an endpoint or a name next to a
secret, an opaque token next to an access identifier, a name or an endpoint.
The join is on the document and a bin of its places, so a long document is many small keys.

Defined results: null text is the empty text and has no span; repeated rows agree; spans belong to an id and a text
together, so rows with a null or repeated id get those of their own text; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import keyed, save
from pulsegrid.llm.spans import free, hits, listed, ranked, where

KINDS = ("assign", "access", "hex")
WEAK = ("endpoint", "login", "opaque")
_ROW = ("doc_id", "_k", "_t")
SCOPE = 256
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
_ENDPOINT = r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}(?![0-9])"
_LOGIN = r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
_OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"
#: Roles: what completes what. A weak part is reported when a part of another, complementary role is near.
_ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identity", "login": "identity", "endpoint": "endpoint"}


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, _k, _t and one array of (start, rank, end, kind) for base and one for weak parts."""
    t = keyed(docs.select("doc_id", "text")).select(*_ROW, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    c = F.col("t")
    out = t.select(
        *_ROW,
        where(c.rlike("[:=]"), hits(c, _ASSIGN)).alias("assign"),
        where(F.instr("t", "AKIA") > 0, hits(c, _ACCESS)).alias("access"),
        where(c.rlike("[0-9a-f]{24}"), hits(c, _HEX)).alias("hex"),
        where(c.rlike(r"://|:[0-9]{2}"), hits(c, _ENDPOINT)).alias("endpoint"),
        where(c.rlike("[:=]"), hits(c, _LOGIN)).alias("login"),
        where(c.rlike("[A-Za-z0-9+/_-]{32}"), hits(c, _OPAQUE)).alias("opaque"),
    )
    out = out.withColumn("assign", F.filter("assign", lambda h: F.length(F.regexp_extract(h["value"], _ASSIGN, 1)) >= 6))
    base = F.concat(*[ranked(F.col(k), k, i) for i, k in enumerate(KINDS)])
    weak = F.concat(*[ranked(F.col(k), k, len(KINDS) + i) for i, k in enumerate(WEAK)])
    out = out.select(*_ROW, base.alias("base"), weak.alias("weak"))
    taken = F.transform("base", lambda b: F.struct(b["start"].alias("s"), b["end"].alias("e")))
    return out.select(*_ROW, "base", free(F.col("weak"), taken).alias("weak"))


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts near a complementary part: _k, _t, start, rank, end, kind."""
    role: Column = F.create_map(*[F.lit(x) for kv in _ROLE.items() for x in kv])

    def marked(column: str) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(column == "weak").alias("w")))

    both = F.concat(marked("base"), marked("weak"))
    rows = parts.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).select("_k", "_t", F.explode(both).alias("p")).select("_k", "_t", "p.*")
    rows = rows.withColumn("role", role[F.col("kind")])
    weak = rows.where("w").withColumn("_bin", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
    near = rows.select("_k", "_t", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("role").alias("_r"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("_bin"))
    near = near.hint("merge").alias("n")
    complete = (F.col("_r") != F.col("role")) & (F.col("_s") < F.col("end") + scope) & (F.col("start") < F.col("_e") + scope) & ((F.col("_r") == "secret") | (F.col("role") == "secret"))
    same = [F.col(f"w.{c}") == F.col(f"n.{c}") for c in ("_k", "_t", "_bin")]
    return weak.alias("w").join(near, same[0] & same[1] & same[2] & complete, "left_semi").select("_k", "_t", "start", "rank", "end", "kind").distinct()


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, _k, _t, ``base`` and ``added``: arrays of (start, rank, end, kind)."""
    parts = save(find_parts(docs), "parts")
    added = link(parts, scope).groupBy("_k", "_t").agg(F.collect_set(F.struct("start", "rank", "end", "kind")).alias("added"))
    none = F.expr("CAST(array() AS array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")
    return parts.select(*_ROW, "base").join(added.hint("merge"), ["_k", "_t"], "left").select(*_ROW, "base", F.coalesce("added", none).alias("added"))


def digest(docs: DataFrame) -> DataFrame:
    """The operator's spans as counts, a digest of the base spans, and the list of all spans."""
    found = secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
