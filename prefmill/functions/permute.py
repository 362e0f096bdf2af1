"""A keyed permutation of 0..n-1 as one expression.

A Feistel network over pairs (left, right) with ``a`` times ``b`` places, where a is the root of n rounded up and
a * b the next number that is n or more. Each round adds a hash of one half to the other, which can be undone
whatever the hash. Where the result is n or more the network is applied again ("cycle walking"); at most
a - 1 places are beyond n, so that is rare, and a walk meets each of them at most once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefmill.functions.keys import md5_int

ROUNDS = 6
#: Applications after the first. Up to n = 4096 no walk is longer; above, one in 64 ** 64.
WALK = 64


def permuted(index: Column, n: Column, seed, epoch: Column) -> Column:
    """Where ``index`` (0..n-1) stands in the order that (seed, epoch) gives; each place is taken once."""
    a = F.ceil(F.sqrt(n)).cast("bigint")
    b = F.ceil(n / a).cast("bigint")

    def network(x: Column) -> Column:
        start = F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("bigint").alias("r"))

        def step(state: Column, i: Column) -> Column:
            even = i % 2 == 0
            added = md5_int(seed, epoch, i, F.when(even, state["r"]).otherwise(state["l"]))
            return F.struct(
                F.when(even, (state["l"] + added % a) % a).otherwise(state["l"]).alias("l"),
                F.when(even, state["r"]).otherwise((state["r"] + added % b) % b).alias("r"),
            )

        rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(rounds, start, step, lambda s: s["r"] * a + s["l"])

    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), network(index), lambda x, _: F.when(x < n, x).otherwise(network(x))
    )
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the walk did not end")).cast("bigint"))
