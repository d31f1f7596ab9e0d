"""Column helpers for the operators that stay in DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
CHUNK = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str, context: int = 40) -> Column:
    """array<struct<start, stop, m, before, after>> of the leftmost non-overlapping matches of a pattern that never matches the empty string.

    start and stop are code points from 0, stop exclusive. Starts are sums of the lengths of what lies before: of whole blocks of matches first,
    then inside the block, so a text with very many matches needs no quadratic time. before and after are what stands around the match, up to the neighbouring matches."""

    def located(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.char_length(m) + F.char_length(g))

        def with_steps(s: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), (F.size(s) / BLOCK).cast("int")), lambda b: total(F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))
            return let(blocks, lambda b: F.transform(found, lambda m, i: one(m, i, s, b)))

        def one(m: Column, i: Column, s: Column, b: Column) -> Column:
            k = F.floor(i / BLOCK).cast("int")
            gap = gaps[i]
            start = total(F.slice(b, F.lit(1), k)) + total(F.slice(s, k * BLOCK + 1, i % BLOCK)) + F.char_length(gap)
            return F.struct(start.alias("start"), (start + F.char_length(m)).alias("stop"), m.alias("m"), F.right(gap, F.lit(context)).alias("before"), F.left(gaps[i + 1], F.lit(context)).alias("after"))

        return let(steps, with_steps)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,stop:int,m:string,before:string,after:string>>")
    return let(found, lambda f: F.when(F.size(f) > 0, let(F.split(text, pattern, -1), lambda g: located(f, g))).otherwise(empty))


def most_before(values: Column) -> Column:
    """For each number of an array of numbers from 0 the largest one before it, 0 for the first; block by block, so a long array needs no quadratic time."""
    top = lambda a: F.coalesce(F.array_max(a), F.lit(0))

    def with_blocks(v: Column, blocks: Column) -> Column:
        def one(i: Column) -> Column:
            k = F.floor(i / BLOCK).cast("int")
            return F.greatest(top(F.slice(blocks, F.lit(1), k)), top(F.slice(v, k * BLOCK + 1, i % BLOCK)))

        return F.transform(v, lambda x, i: one(i))

    return let(values, lambda v: let(F.transform(F.sequence(F.lit(0), (F.size(v) / BLOCK).cast("int")), lambda b: top(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))), lambda blocks: with_blocks(v, blocks)))


def count_below(ordered: Column, x: Column, or_equal: bool) -> Column:
    """How many numbers of an ascending array are below x (or equal to it), by halving."""

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        there = F.get(ordered, middle)
        below = there <= x if or_equal else there < x
        go = a["lo"] < a["hi"]
        return F.struct(F.when(go & below, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(go & ~below, middle).otherwise(a["hi"]).alias("hi"))

    n = F.size(ordered)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda a: a["lo"])


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, stop: Column) -> Column:
    """The code points from start (from 0) to stop of a text that is given as chunks()."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor((stop - 1) / CHUNK).cast("int")
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    inside = F.substring(piece(a), (start % CHUNK + 1).cast("int"), (stop - start).cast("int"))
    middle = F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    return F.when(stop <= start, "").when(a == b, inside).otherwise(F.concat(F.substring(piece(a), (start % CHUNK + 1).cast("int"), F.lit(CHUNK)), middle, F.left(piece(b), ((stop - 1) % CHUNK + 1).cast("int"))))
