"""Spans of pattern matches as native expressions: where each match lies, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIT = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"
#: Code points of nearby text that a match keeps on each side.
CONTEXT = 256
#: Folds over arrays go in blocks of this many elements, and over blocks, so what they append to stays short.
_FOLD = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an expression that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefix(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running ``op`` over an array, the element itself included."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / _FOLD).cast("int")), lambda b: F.slice(values, b * _FOLD + 1, F.lit(_FOLD)))

    def inside(x: Column, before: Column) -> Column:
        run = F.aggregate(x, F.array(before), lambda acc, v: F.array_append(acc, op(F.element_at(acc, -1), v)))
        return F.slice(run, F.lit(2), F.lit(_FOLD))

    def over(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, F.array(zero), lambda acc, x: F.array_append(acc, F.aggregate(x, F.element_at(acc, -1), op)))
        return bound(offsets, lambda o: F.flatten(F.transform(blocks, lambda x, i: inside(x, F.element_at(o, i + 1)))))

    return bound(blocks, over)


def hits(text: Column, pattern: str, context: int = CONTEXT) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` with their code-point places and nearby text.

    The stretches between matches and the matches themselves add up to the text, so running lengths
    are places. ``pattern`` must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def named(found: Column, gaps: Column) -> Column:
        n = F.size(found)
        zipped = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), n).alias("g"), F.slice(gaps, F.lit(2), n).alias("h"))
        return F.transform(zipped, lambda z: F.struct(z["m"].alias("m"), z["g"].alias("g"), z["h"].alias("h")))

    def placed(z: Column) -> Column:
        ends = prefix(F.transform(z, lambda x: (F.length(x["g"]) + F.length(x["m"])).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        hit = lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("value"), F.right(x["g"], F.lit(context)).alias("before"), F.left(x["h"], F.lit(context)).alias("after"))
        return F.zip_with(z, ends, hit)

    none = F.expr(f"CAST(array() AS {_HIT})")
    return bound(found, lambda f: F.when(F.size(f) == 0, none).otherwise(bound(named(f, gaps), placed)))


def free(found: Column, taken: Column) -> Column:
    """The elements of ``found`` that overlap no (s, e) of ``taken``, by halving in its sorted starts and running largest ends."""

    def overlaps(h: Column, starts: Column, ends: Column) -> Column:
        middle = lambda s: F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")

        def halve(s: Column, _: Column) -> Column:
            below = F.element_at(starts, middle(s)) < h["end"]
            lo = F.when(s["lo"] >= s["hi"], s["lo"]).when(below, middle(s)).otherwise(s["lo"])
            hi = F.when(s["lo"] >= s["hi"], s["hi"]).when(below, s["hi"]).otherwise(middle(s) - 1)
            return F.struct(lo.alias("lo"), hi.alias("hi"))

        first = F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi"))
        last = F.aggregate(F.sequence(F.lit(1), F.lit(31)), first, halve, lambda s: s["lo"])
        return F.when(last > 0, bound(last, lambda k: F.element_at(ends, k) > h["start"])).otherwise(F.lit(False))

    def search(t: Column) -> Column:
        ends = prefix(F.transform(t, lambda x: x["e"].cast("long")), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        return bound(F.transform(t, lambda x: x["s"]), lambda starts: bound(ends, lambda e: F.filter(found, lambda h: ~overlaps(h, starts, e))))

    return F.when(F.size(taken) == 0, found).when(F.size(found) == 0, found).otherwise(bound(F.array_sort(taken), search))


def where(condition: Column, found: Column) -> Column:
    """``found`` where the cheap test holds, else no match: most texts are never searched."""
    return F.when(condition, found).otherwise(F.expr(f"CAST(array() AS {_HIT})"))


def ranked(found: Column, kind: str, rank: int) -> Column:
    """Drop the context, add the kind and its rank for ordering."""
    return F.transform(found, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
