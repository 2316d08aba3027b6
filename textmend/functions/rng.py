"""Random numbers from counters: the same row, place and seed give the same number on every cluster and in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Primes below 2^31, so that no product of two leaves 64 bits, and a place's factor.
MODULUS, PRIMES, FACTOR = 2147483647, (7919, 65521, 48271, 69621), 40503


def row_seed(seed: int, row: Column) -> Column:
    """A number of the row and the seed; work it out once per row."""
    x = (row % MODULUS * PRIMES[0] + F.lit(seed * 1_000_003 + 17)) % MODULUS
    x = x * (x % PRIMES[1] + 1) % MODULUS
    return x * (x % PRIMES[1] + 1) % MODULUS


def at_place(row_seed: Column, place: Column) -> Column:
    """A double in [0, 1) for a place within the row."""
    x = (row_seed + (place.cast("long") + FACTOR) * PRIMES[3]) % MODULUS
    return x * (x % PRIMES[1] + 1) % MODULUS * PRIMES[2] % MODULUS / F.lit(float(MODULUS))


def uniform(seed: int, row: Column) -> Column:
    return at_place(row_seed(seed, row), F.lit(0))


def row_seed_sql(seed: int, row: str) -> str:
    x = f"((({row}) % {MODULUS} * {PRIMES[0]} + {seed * 1_000_003 + 17}) % {MODULUS})"
    x = f"({x} * ({x} % {PRIMES[1]} + 1) % {MODULUS})"
    return f"({x} * ({x} % {PRIMES[1]} + 1) % {MODULUS})"


def uniform_sql(seed: int, row: str, place: str = "0") -> str:
    """The same in SQL."""
    x = f"(({row_seed_sql(seed, row)} + (cast({place} as bigint) + {FACTOR}) * {PRIMES[3]}) % {MODULUS})"
    return f"({x} * ({x} % {PRIMES[1]} + 1) % {MODULUS} * {PRIMES[2]} % {MODULUS} / {MODULUS}.0)"
