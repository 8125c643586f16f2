"""Matches of patterns with their code-point positions, as Columns: no Python runs on the executors.

Spark copies the accumulator of an aggregate at each step and scans a string from its start for each substring, so sums and
merges here go by blocks of about the square root of the list, and texts are cut into chunks before parts of them are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,value:string>>"
NONE = f"cast(array() as {SPANS})"
#: Stand for a match's edge and for a joint inside a match; texts that hold them get another control character there.
EDGE, JOINT = "\x01", "\x02"
#: Characters of a chunk.
CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain(text: Column) -> Column:
    """The text without the two control characters, of equal length."""
    return F.translate(F.coalesce(text, F.lit("")), EDGE + JOINT, "\x03\x03")


def blocks(items: Column) -> Column:
    """The (bound) list cut into lists of about the square root of its size."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items)))).cast("int")
    return let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int")), lambda k: F.slice(items, k * n + 1, n)))


def running(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What `step` (associative, 0 changes nothing) makes of all items before each of a (bound) list of numbers that is not empty."""
    fold = lambda part: F.aggregate(part, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))
    within = let(blocks(items), lambda b: F.transform(b, fold))
    return let(
        within,
        lambda w: let(
            fold(F.transform(w, lambda s: F.element_at(s, -1))),
            lambda before: F.flatten(F.transform(w, lambda s, k: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: step(F.get(before, k), x)))),
        ),
    )


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern in a `plain` text: start, end (exclusive), value."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{EDGE}$0{EDGE}")), EDGE, -1)

    def matches(p: Column) -> Column:
        def placed(n: Column) -> Column:
            of = lambda starts: F.transform(
                F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)),
                lambda k: F.struct(F.get(starts, k).alias("start"), (F.get(starts, k) + F.get(n, k)).alias("end"), F.get(p, k).alias("value")),
            )
            return let(running(n, lambda a, b: a + b), of)

        return F.when(F.size(p) > 1, let(F.transform(p, F.length), placed)).otherwise(none())

    return let(parts, matches)


def none() -> Column:
    return F.expr(NONE)


def chunks(text: Column) -> Column:
    """The text in chunks of CHUNK characters, so that `part` need not scan all before it."""
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / CHUNK).cast("int")), lambda k: F.substring(t, k * CHUNK + 1, F.lit(CHUNK)))
    return let(text, lambda t: F.when(F.length(t) <= CHUNK, F.array(t)).otherwise(cut(t)))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from start to end (exclusive) of a text in (bound) chunks."""
    low, high = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    of = lambda k: F.substring(F.coalesce(F.get(pieces, k), F.lit("")), F.greatest(start - k * CHUNK, F.lit(0)) + 1, F.least(end - k * CHUNK, F.lit(CHUNK)) - F.greatest(start - k * CHUNK, F.lit(0)))
    return F.when(end <= start, F.lit("")).when(low == high, of(low)).otherwise(F.array_join(F.transform(F.sequence(low, high), of), ""))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end of each tagged span, comma-joined, in the given order."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def apart(spans: Column, base: Column) -> Column:
    """Those of `spans` (a list from `find`: sorted, none overlapping another) that overlap none of `base`."""
    clear = lambda m, near: ~F.exists(near, lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"]))

    def of(block: Column, base: Column) -> Column:
        low, high = F.element_at(block, 1)["start"], F.element_at(block, -1)["end"]
        near = let(F.struct(low.alias("low"), high.alias("high")), lambda at: F.filter(base, lambda b: (b["start"] < at["high"]) & (at["low"] < b["end"])))
        return let(near, lambda n: F.filter(block, lambda m: clear(m, n)))

    split = lambda s, b: F.flatten(F.transform(blocks(s), lambda block: of(block, b)))
    return let(spans, lambda s: let(base, lambda b: F.when((F.size(s) == 0) | (F.size(b) == 0), s).otherwise(split(s, b))))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with the spans (tagged, sorted by start) replaced by `mask`; overlapping ones are replaced together."""

    def of(pieces: Column, s: Column, length: Column) -> Column:
        def cut(covered: Column) -> Column:
            gap = lambda k: part(pieces, F.get(covered, k), F.get(s, k)["start"])
            kept = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(F.get(s, k)["start"] >= F.get(covered, k), F.concat(gap(k), F.lit(mask))).otherwise(F.lit("")))
            return F.concat(F.array_join(kept, ""), part(pieces, F.greatest(F.element_at(covered, -1), F.element_at(s, -1)["end"]), length))

        return let(let(F.transform(s, lambda m: m["end"]), lambda ends: running(ends, F.greatest)), cut)

    return let(chunks(text), lambda p: let(spans, lambda s: F.when(F.size(s) > 0, of(p, s, F.length(text))).otherwise(text)))
