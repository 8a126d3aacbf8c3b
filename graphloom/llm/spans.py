"""Matches of regular expressions with their places, in built-in functions only.

Spark has no function that returns the places of all matches.  Splitting by a pattern gives the text between
the matches; lengths of what lies between and of the matches, summed up, give the places.  Sums and maxima run in
two levels of blocks, and parts of texts are taken from chunks, so that a text with very many matches costs little
more than its length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
SPAN = "array<struct<start:int,end:int,match:string,part:string>>"
#: Characters of a chunk of text.
CHUNK = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sums(block: Column) -> Column:
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), x["g"].alias("part"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one).cast(SPAN)).alias("out"))

    return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)


def _blocks(values: Column, each: Callable[[Column], Column]) -> Column:
    """``each`` of the blocks of an array, one at least."""
    return F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int")), lambda b: each(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))


def _last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def running_max(values: Column) -> Column:
    """Of an array of ints: the largest value up to each."""
    none = F.array().cast("array<int>")

    def joined(blocks: Column) -> Column:
        largest = F.aggregate(blocks, F.array(F.lit(None).cast("int")), lambda acc, b: F.concat(acc, F.array(F.greatest(_last(acc), _last(b)))))
        return let(largest, lambda before: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: F.greatest(x, F.get(before, k))))))

    def scanned(block: Column) -> Column:
        return F.aggregate(block, none, lambda acc, x: F.concat(acc, F.array(F.greatest(x, _last(acc)))))

    return let(values, lambda v: let(_blocks(v, scanned), joined))


def chunks(text: Column) -> Column:
    """``text`` in pieces of CHUNK characters, for ``between``: taking a part from the text itself counts from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` (exclusive) of the text that ``chunks`` cut."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * CHUNK + 1, end - start)).otherwise("")


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` as SPAN, places in code points, end exclusive.

    ``part`` is the given group.  A null text has no matches.  Patterns must not match the empty string.
    """

    def places(t: Column, matches: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else matches
        zipped = F.arrays_zip(F.split(t, pattern, -1), matches, parts).cast("array<struct<p:string,m:string,g:string>>")

        def joined(bs: Column) -> Column:
            bases = F.aggregate(bs, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(_last(acc) + b["at"])))
            return let(
                bases,
                lambda base: F.flatten(
                    F.transform(bs, lambda b, k: F.transform(b["out"], lambda s: F.struct((s["start"] + F.get(base, k)).alias("start"), (s["end"] + F.get(base, k)).alias("end"), s["match"], s["part"])))
                ),
            )

        # the last piece has no match: arrays_zip pads it with null
        return F.filter(let(let(zipped, lambda z: _blocks(z, _sums)), joined), lambda s: s["match"].isNotNull())

    none = F.array().cast(SPAN)

    def found(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, places(t, m)).otherwise(none))

    return F.when(text.isNull(), none).otherwise(let(text, found))


KINDED = "array<struct<start:int,rank:int,end:int,kind:string>>"


def kinded(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))).cast(KINDED)


def merged(spans: Sequence[Column]) -> Column:
    """Kinded spans by start, then kind."""
    return F.array_sort(F.concat(*spans))


def told(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def clear_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (structs with start and end) that overlap none of ``others``, by start."""
    mine = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("s")))
    theirs = F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), F.get(spans, F.lit(-1)).alias("s")))

    def body(both: Column) -> Column:
        # the furthest end of the others that begin no later, and the nearest start of those that begin no earlier
        ends = running_max(F.transform(both, lambda x: F.when(x["s"].isNull(), x["end"]).otherwise(-1)))
        starts = F.reverse(running_max(F.reverse(F.transform(both, lambda x: F.when(x["s"].isNull(), -x["start"]).otherwise(-(2**31) + 1)))))
        zipped = F.arrays_zip(both.alias("x"), ends.alias("before"), starts.alias("after"))
        alone = F.filter(zipped, lambda z: z["x"]["s"].isNotNull() & (z["before"] <= z["x"]["start"]) & (-z["after"] >= z["x"]["end"]))
        return F.transform(alone, lambda z: z["x"]["s"])

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.array_sort(F.concat(mine, theirs)), body))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with each maximal run of sorted, perhaps overlapping or touching spans replaced by ``mask``.

    A null text stays null; a text without spans stays as it is.  The cost is that of the text and of the spans.
    """

    def body(ends: Column) -> Column:
        # a span that begins before an earlier one ends, or just there, is covered by that one's mask
        at = F.transform(spans, lambda s, k: F.struct(F.get(ends, k - 1).alias("from"), s["start"].alias("to")))
        fresh = F.filter(at, lambda x: x["from"].isNull() | (x["to"] > x["from"]))
        out = let(chunks(text), lambda c: F.concat(F.array_join(F.transform(fresh, lambda x: F.concat(between(c, F.coalesce(x["from"], F.lit(0)), x["to"]), F.lit(mask))), ""), between(c, _last(ends), F.length(text))))
        return out

    return F.when(F.size(spans) > 0, let(running_max(F.transform(spans, lambda s: s["end"])), body)).otherwise(text)
