"""Arrays as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value) with value worked out once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that running values are appended to one by one.
BLOCK = 256


def _running(numbers: Column, combine) -> Column:
    """Appending copies what is there, so long arrays are worked through in blocks, and the blocks' last values are carried
    into what follows."""

    def appended(x: Column) -> Column:
        def add(a: Column, v: Column) -> Column:
            v = v.cast("bigint")
            return F.concat(a, F.array(F.when(F.size(a) == 0, v).otherwise(combine(F.try_element_at(a, F.lit(-1)), v))))

        return F.aggregate(x, F.array().cast("array<bigint>"), add)

    def blocked(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: appended(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
        carried = lambda parts, ends: F.flatten(F.transform(parts, lambda p, b: F.when(b == 0, p).otherwise(F.transform(p, lambda v: combine(v, F.get(ends, b - 1))))))
        return let(blocks, lambda parts: let(appended(F.transform(parts, lambda p: F.element_at(p, -1))), lambda ends: carried(parts, ends)))

    return let(numbers, lambda x: F.when(F.size(x) <= BLOCK, appended(x)).otherwise(blocked(x)))


def running_sums(numbers: Column) -> Column:
    """array<bigint>: the sum of each element and all before it."""
    return _running(numbers, lambda a, b: a + b)


def sums_before(numbers: Column, places: Column) -> Column:
    """array<bigint>: the sum of all elements before each of some ascending places (from 0). Each element is added once, and
    only as many values run on as there are places."""

    def between(m: Column) -> Column:
        def one(place: Column, j: Column) -> Column:
            last = F.when(j == 0, F.lit(0)).otherwise(F.get(m["places"], j - 1))
            return F.aggregate(F.slice(m["numbers"], last + 1, place - last), F.lit(0).cast("bigint"), lambda a, x: a + x)

        return F.transform(m["places"], one)

    return running_sums(let(F.struct(numbers.alias("numbers"), places.alias("places")), between))


def running_max(numbers: Column) -> Column:
    """array<bigint>: the greatest of each element and all before it."""
    return _running(numbers, F.greatest)


def number_up_to(ascending: Column, x: Column) -> Column:
    """int: how many elements of an ascending array are no greater than x, by halving (up to 2^25 elements); null of null."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    return F.when(ascending.isNotNull() & x.isNotNull(), F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(ascending, at + s - 1) <= x, at + s).otherwise(at)))
