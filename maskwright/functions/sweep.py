"""Left folds over arrays that emit elements, for arrays of any length.

The accumulator of ``aggregate`` is copied with all it holds at every step, so an array that grows in it costs
quadratic time. Here no array grows with the items: the fold's state, of fixed size, is computed at every
1,024th item, from there at every 32nd, and from there before each item, which then emits what it has to.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRIDE = 32


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def none_of(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def sweep(
    items: Column,
    state: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    state_type: str,
    element: str,
    stride: int = STRIDE,
) -> Column:
    """Folds ``step(state, item)`` over ``items``; returns what ``emit(state before the item, item)`` gives that is not null."""

    def folded(all_items: Column, start: Column, first: Column, end: Column) -> Column:
        through = F.aggregate(
            F.sequence(first, end - 1), start.cast(state_type), lambda s, i: step(s, F.get(all_items, i)).cast(state_type)
        )
        return F.when(first < end, through).otherwise(start.cast(state_type))

    def over(all_items: Column) -> Column:
        size = F.size(all_items)
        large = stride * stride
        count = lambda every: F.floor((size - 1) / every).cast("int")

        grow = lambda acc, b: F.concat(acc, F.array(folded(all_items, F.element_at(acc, -1), b * large, b * large + large)))
        begun = F.array(state.cast(state_type))
        coarse = F.when(size > large, F.aggregate(F.sequence(F.lit(0), count(large) - 1), begun, grow)).otherwise(begun)

        def before_each(coarse_states: Column) -> Column:
            def at(j: Column) -> Column:
                block = F.floor(j / stride).cast("int")
                return folded(all_items, F.get(coarse_states, block), block * large, j * stride)

            return F.transform(F.sequence(F.lit(0), count(stride)), at)

        def emitted(states: Column) -> Column:
            def one(i: Column) -> Column:
                block = F.floor(i / stride).cast("int")
                item = F.get(all_items, i)
                return emit(folded(all_items, F.get(states, block), block * stride, i), item).cast(element)

            return F.filter(F.transform(F.sequence(F.lit(0), size - 1), one), lambda e: e.isNotNull())

        return F.when(size > 0, let(let(coarse, before_each), emitted)).otherwise(none_of(element))

    return let(items, over)


def groups_at(items: Column, firsts: Column) -> Column:
    """``items`` cut before each of the (ascending, zero-based) positions ``firsts``, the first of which is 0."""

    def group(first: Column, k: Column) -> Column:
        end = F.coalesce(F.get(firsts, k + 1), F.size(items))
        # ``slice`` would copy all items for each group.
        return F.transform(F.sequence(first, end - 1), lambda i: F.get(items, i))

    return F.transform(firsts, group)
