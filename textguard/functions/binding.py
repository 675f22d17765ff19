"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used.

    A column named twice inside lambdas is otherwise inlined and run again for every
    mention, which would repeat the pattern scans.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def attach(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a one-element generator.

    Filters on the new column stay above the generator and later projections do not
    inline it, so ``value`` runs once per row. Unused input columns are still pruned.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


GROUP = 128


def fold_into_array(
    items: Column,
    state: Column,
    empty: Column,
    step: Callable[[Column, Column], tuple[Column, Column]],
) -> Column:
    """Fold over an array with a small state, appending to an output array on the way.

    ``step(state, item)`` gives the next state and the array to append; ``empty`` is an
    empty output array. Appending copies what is there, so items are taken in groups
    whose outputs are put together at the end: the cost stays close to linear.
    """

    def over(values: Column, state: Column) -> Column:
        def merge(acc: Column, item: Column) -> Column:
            following, found = step(acc["state"], item)
            return F.struct(
                following.alias("state"), F.concat(acc["out"], found).alias("out")
            )

        return F.aggregate(values, F.struct(state.alias("state"), empty.alias("out")), merge)

    def grouped(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), F.lit(GROUP))
        groups = F.transform(starts, lambda at: F.slice(values, at, F.lit(GROUP)))
        begin = F.struct(
            state.alias("state"), F.slice(F.array(empty), 1, 0).alias("outs")
        )

        def merge(acc: Column, group: Column) -> Column:
            return bind(
                over(group, acc["state"]),
                lambda r: F.struct(
                    r["state"].alias("state"),
                    F.concat(acc["outs"], F.array(r["out"])).alias("outs"),
                ),
            )

        return F.flatten(F.aggregate(groups, begin, merge, lambda acc: acc["outs"]))

    return bind(items, lambda values: F.when(F.size(values) > 0, grouped(values)).otherwise(empty))


BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS


def cut_blocks(text: Column) -> Column:
    """A text as an array of blocks of ``BLOCK`` code points, the last one shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(BLOCK))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(BLOCK)))


def cut_piece(blocks: Column, begin: Column, end: Column) -> Column:
    """``text[begin:end]`` out of its blocks, without walking the text from its start."""
    first, last = F.shiftright(begin, BLOCK_BITS), F.shiftright(end - 1, BLOCK_BITS)
    within = F.substring(F.get(blocks, first), begin % BLOCK + 1, end - begin)
    across = F.concat(
        F.substring(F.get(blocks, first), begin % BLOCK + 1, F.lit(BLOCK)),
        F.array_join(F.slice(blocks, first + 2, last - first - 1), ""),
        F.substring(F.get(blocks, last), F.lit(1), (end - 1) % BLOCK + 1),
    )
    return F.when(end <= begin, F.lit("")).when(first == last, within).otherwise(across)


def remember(build: Callable[..., Column]) -> Callable[..., Column]:
    """Let a column function take column names, and build each such column only once.

    Large expressions take many calls into the JVM to put together. A column made from
    names alone is not tied to a DataFrame and can be used again in the same context.
    """
    made: dict[tuple, Column] = {}

    @wraps(build)
    def column(text: Column | str, *args) -> Column:
        if not isinstance(text, str):
            return build(text, *args)
        key = (SparkContext.getOrCreate(), text, *args)
        if key not in made:
            made[key] = build(F.col(text), *args)
        return made[key]

    return column
