"""Small helpers for array expressions that stay linear in the array length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Projections may be merged by the optimizer, and a merged expression inside a
    lambda would be evaluated again for each element. A lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``let`` for several values at once."""
    packed = F.struct(*[v.alias(k) for k, v in values.items()])
    return let(packed, lambda s: body({k: s[k] for k in values}))


def indices(array: Column) -> Column:
    """``[0 .. n-1]``, or an empty array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def split_at(array: Column, starts: Column) -> Column:
    """Cut ``array`` into consecutive pieces that begin at the (sorted) ``starts``.

    Both arguments must be cheap to evaluate repeatedly (columns or lambda variables).
    Linear: each element is copied into exactly one slice.
    """
    return F.transform(
        starts,
        lambda s, k: F.slice(
            array, s + 1, F.coalesce(F.get(starts, k + 1), F.size(array)) - s
        ),
    )


def islands(array: Column, is_start: Callable[[Column, Column], Column]) -> Column:
    """Group neighbouring elements; ``is_start(element, index)`` opens a new group."""
    return let(
        array,
        lambda a: let(
            F.filter(indices(a), lambda i: is_start(F.get(a, i), i)),
            lambda starts: split_at(a, starts),
        ),
    )


_built: dict = {}


def reuse(key: tuple, build: Callable[[], Column]) -> Column:
    """Keep a large expression for the life of the Spark context.

    Expressions never change and refer to columns by name, but building a large one takes
    thousands of small calls into the JVM.
    """
    context = SparkContext._active_spark_context
    if _built.get("context") is not context:
        _built.clear()
        _built["context"] = context
    if key not in _built:
        _built[key] = build()
    return _built[key]


FOLD_BLOCK = 1024


def fold_text(size: Column, zero: dict[str, Column],
              step: Callable[[dict[str, Column], Column], tuple[dict[str, Column], Column]]) -> Column:
    """Walk over positions ``0 .. size-1`` with a small state; add a piece of text for each.

    ``step(state, i)`` returns the next state and a piece. A fold copies its accumulator at
    every step, so the text is built block by block: the cost stays close to linear in the
    array's length.
    """
    names = list(zero)

    def pack(values: dict[str, Column], flags: Column) -> Column:
        return F.struct(*[values[n].alias(n) for n in names], flags.alias("flags"))

    def one(acc: Column, i: Column) -> Column:
        values, flag = step(acc, i)
        return pack(values, F.concat(acc["flags"], flag))

    def block(acc: Column, first: Column) -> Column:
        positions = F.sequence(first, F.least(first + FOLD_BLOCK, size) - 1)
        inner = F.aggregate(positions, pack({n: acc[n] for n in names}, F.lit("")), one)
        return let(
            inner,
            lambda r: pack({n: r[n] for n in names}, F.concat(acc["flags"], r["flags"])),
        )

    firsts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(FOLD_BLOCK))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(firsts, pack(zero, F.lit("")), block, lambda acc: acc["flags"])


def fold_flags(size: Column, zero: dict[str, Column],
               step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """``fold_text`` with one letter for each position: an array of the letters."""
    return F.regexp_extract_all(fold_text(size, zero, step), F.lit("."), F.lit(0))


def compute(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a column that is evaluated exactly once per row.

    A filter on an ordinary computed column is pushed below it, which repeats the whole
    expression (and may move it in front of a repartitioning). A generated column stops
    that. Use it for expensive expressions with a filter behind them.
    """
    return df.select(
        *[c for c in df.columns if c != name], F.explode_outer(F.array(expr)).alias(name)
    )


def explode_rows(df: DataFrame, keys: list[str], array: Column, index: str,
                 fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per array element, with its position.

    The outer form is used on purpose: the plain one lets the optimizer add a filter on
    the array's size, which would build the array twice.
    """
    out = df.select(*keys, F.posexplode_outer(array).alias(index, "_x"))
    return out.filter(F.col(index).isNotNull()).select(
        *keys, index, *[f(F.col("_x")).alias(n) for n, f in fields.items()]
    )
