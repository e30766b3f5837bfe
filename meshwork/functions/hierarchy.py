"""Hierarchical machines as column expressions: distances, levels, group numbers and identifiers of processing elements (PEs).

A machine `a1:a2:...:al` has its innermost level first: PEs x and y share a group of level i iff x div S_i = y div S_i, with S_i = a1*...*ai.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Machine:
    sizes: tuple[int, ...]
    distances: tuple[int, ...]

    def __post_init__(self):
        if len(self.sizes) != len(self.distances) or not self.sizes or min(self.sizes) < 1:
            raise ValueError("a machine needs as many distances as levels, and levels of size 1 at least")

    @classmethod
    def parse(cls, hierarchy: str, distance: str) -> Machine:
        ints = lambda s: tuple(int(x) for x in s.strip().split(":"))
        return cls(ints(hierarchy), ints(distance))

    @classmethod
    def flat(cls, k: int) -> Machine:
        """The machine of plain graph partitioning: all blocks at distance 1."""
        return cls((k,), (1,))

    @property
    def k(self) -> int:
        return math.prod(self.sizes)

    @property
    def strides(self) -> list[int]:
        return list(accumulate(self.sizes, mul))

    # distances ---------------------------------------------------------------------------------------------------

    def distance(self, x: Column, y: Column) -> Column:
        """By integer divisions, the highest level whose digit differs. The default: no table, and Catalyst compiles it."""
        out = F.when(x == y, F.lit(0).cast("long"))
        for s, d in list(zip(self.strides, self.distances, strict=True))[:-1]:
            out = out.when(_div(x, s) == _div(y, s), F.lit(d).cast("long"))
        return out.otherwise(F.lit(self.distances[-1]).cast("long"))

    def level(self, x: Column, y: Column) -> Column:
        """0 for the same PE and for PEs of one innermost group, then the number of the level that separates them, less one."""
        out = F.lit(len(self.sizes) - 1)
        for i in range(len(self.sizes) - 2, -1, -1):
            out = F.when(_div(x, self.strides[i]) == _div(y, self.strides[i]), F.lit(i)).otherwise(out)
        return out.cast("int")

    def last_level_pair(self, x: Column, y: Column) -> Column:
        return _div(x, self.sizes[0]) == _div(y, self.sizes[0])

    def are_neighbors(self, x: Column, y: Column, level: int) -> Column:
        """Whether both lie in one group of the level (0: innermost)."""
        return _div(x, self.strides[level]) == _div(y, self.strides[level])

    def identifier(self, x: Column) -> Column:
        """The PE's digits, outermost first, each in as many bits as its level needs (one at least)."""
        out, shift, below = F.lit(0).cast("long"), 0, 1
        for size in self.sizes:
            out = out.bitwiseOR(F.shiftleft((_div(x, below) % size).cast("long"), shift))
            shift, below = shift + max(1, (size - 1).bit_length()), below * size
        if shift > 63:
            raise ValueError("identifiers of more than 63 bits")
        return out

    def distance_by_bits(self, id_x: Column, id_y: Column) -> Column:
        """From two identifiers: the place of the highest bit in which they differ tells the level."""
        bits = [d for size, d in zip(self.sizes, self.distances, strict=True) for _ in range(max(1, (size - 1).bit_length()))]
        table = F.array(F.lit(0).cast("long"), *[F.lit(d).cast("long") for d in bits])
        diff = id_x.bitwiseXOR(id_y)
        return F.element_at(table, F.when(diff == 0, 1).otherwise(F.length(F.bin(diff)) + 1))

    # tables ------------------------------------------------------------------------------------------------------

    def pes(self, spark: SparkSession) -> DataFrame:
        """(pid, g1..gl, ident): the group numbers of every PE, for joins that look distances up by equality of groups."""
        x = F.col("id")
        groups = [_div(x, s).alias(f"g{i + 1}") for i, s in enumerate(self.strides)]
        return spark.range(self.k).select(x.alias("pid"), *groups, self.identifier(x).alias("ident"))

    def distance_by_groups(self, a: str, b: str) -> Column:
        """The distance of two joined rows of `pes` (aliases a and b)."""
        out = F.when(F.col(f"{a}.pid") == F.col(f"{b}.pid"), F.lit(0).cast("long"))
        for i, d in enumerate(self.distances):
            out = out.when(F.col(f"{a}.g{i + 1}") == F.col(f"{b}.g{i + 1}"), F.lit(d).cast("long"))
        return out

    def matrix(self, spark: SparkSession) -> DataFrame:
        """(a, b, d, h) of all pairs: k^2 rows, for small machines."""
        a, b = F.col("a"), F.col("b")
        pairs = spark.range(self.k * self.k).select(_div(F.col("id"), self.k).alias("a"), (F.col("id") % self.k).alias("b"))
        return pairs.select("a", "b", self.distance(a, b).alias("d"), self.level(a, b).alias("h"))

    def oracle(self) -> str:
        """Which form `auto` picks: identifiers from more than 1024 PEs on."""
        return "binary" if self.k > 1024 else "division"

    def auto_distance(self, x: Column, y: Column) -> Column:
        """The distance in the form that `oracle` picks."""
        return self.distance_by_bits(self.identifier(x), self.identifier(y)) if self.oracle() == "binary" else self.distance(x, y)

    # for kernels and SQL -----------------------------------------------------------------------------------------

    def between(self, x: int, y: int) -> int:
        if x == y:
            return 0
        return next((d for s, d in zip(self.strides, self.distances, strict=True) if x // s == y // s), self.distances[-1])

    def sql(self, x: str, y: str, level: bool = False) -> str:
        """The same as CASE for DuckDB (integer division is //)."""
        if level:
            cases = " ".join(f"WHEN ({x}) // {s} = ({y}) // {s} THEN {i}" for i, s in enumerate(self.strides[:-1]))
            return f"CASE {cases} ELSE {len(self.sizes) - 1} END" if cases else "0"
        cases = " ".join(f"WHEN ({x}) // {s} = ({y}) // {s} THEN {d}" for s, d in list(zip(self.strides, self.distances, strict=True))[:-1])
        return f"CASE WHEN ({x}) = ({y}) THEN 0 {cases} ELSE {self.distances[-1]} END"


def _div(x: Column, n: int) -> Column:
    return F.floor(x / F.lit(n)).cast("long") if n > 1 else x.cast("long")
