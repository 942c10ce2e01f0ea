"""Places, running totals and medians within keys of any size.

A window over a key holds the key's rows in one task. Here rows are first dealt into slices, ranges of the key and the order within it whose bounds come from a sample of the rows. A slice's rows are numbered or summed on their own; what lies in a key's earlier slices is carried on. A key that holds all rows is so spread over all slices, and rows that tie in the order are parted by its last column. The sample decides about the load alone, never about the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices, and rows sampled for each.
SLICES, SAMPLED = 64, 32
#: How values are added up, and how a total is joined to what was carried on.
HOW = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0)))), "min": (F.min, F.least)}


def _struct(names: list[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def cuts(df: DataFrame, names: list[str], slices: int = SLICES) -> list:
    """At most slices - 1 rows of the columns names, ascending, that part df's rows about evenly. One row of each of a fixed number of hash ranges is looked at."""
    h = F.xxhash64(*names)
    some = df.select(F.pmod(h, F.lit(slices * SAMPLED)).alias("b_"), F.struct(h.alias("h_"), *names).alias("r_")).groupBy("b_").agg(F.min("r_").alias("r_"))
    some = some.select("r_.*").withColumn("n_", F.row_number().over(Window.orderBy(_struct(names)))).withColumn("all_", F.count(F.lit(1)).over(Window.partitionBy()))  # of slices * SAMPLED rows
    step = F.greatest(F.ceil(F.col("all_") / slices), F.lit(1))
    return some.filter((F.col("n_") % step == 0) & (F.col("n_") < F.col("all_"))).orderBy("n_").select(*names).collect()


def _slice(df: DataFrame, names: list[str], bounds: list) -> Column:
    """How many of the bounds lie before a row: a search by halves."""
    types = [df.schema[n].dataType for n in names]
    row = _struct(names)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        cut = F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(bounds[mid], types, names, strict=True)])
        return F.when(row > cut, search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds))


def _joined(df: DataFrame, few: DataFrame, names: list[str], how: str) -> DataFrame:
    """df with the columns of few, rows of slices and keys, where both agree in names; null equals null."""
    few = few.withColumnsRenamed({n: f"{n}_of_few" for n in names})
    out = df.join(F.broadcast(few), reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"{n}_of_few")) for n in names]), how)
    return out.drop(*[f"{n}_of_few" for n in names])


def sliced(df: DataFrame, keys: list[str], order: list[Column], slices: int = SLICES) -> tuple[DataFrame, list]:
    """(df with its order as o0_, o1_, ... and its slice_, the bounds' keys)."""
    df = df.withColumns({f"o{i}_": c for i, c in enumerate(order)})
    names = [*keys, *(f"o{i}_" for i in range(len(order)))]
    bounds = cuts(df, names, slices)
    return df.withColumn("slice_", _slice(df, names, bounds)), sorted({tuple(b[: len(keys)]) for b in bounds}, key=str)


def running(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column], how: str = "sum", back: bool = False, slices: int = SLICES, slice_: Column | None = None) -> DataFrame:
    """df with, for each of totals, what its values add up to over the key's rows up to and with this one, or from this one on (back). order ascends, nulls first, and leaves no ties. slice_: a slice that is known to follow the order, so no sample is needed; its keys are few."""
    if slice_ is None:
        df, parted = sliced(df, keys, order, slices)
    else:
        df, parted = df.withColumns({f"o{i}_": c for i, c in enumerate(order)} | {"slice_": slice_}), None
    add, join = HOW[how]
    by = [F.desc(f"o{i}_") if back else F.asc(f"o{i}_") for i in range(len(order))]
    kept = [c for c in df.columns if c != "slice_" and not (c[0] == "o" and c[1:-1].isdigit() and c[-1] == "_")]
    df = df.withColumns({f"v_{n}": c for n, c in totals.items()})
    some = df
    if keys and parted is not None:  # only keys of bounds lie in more slices than one
        some = df.filter(reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, p, strict=True)]) for p in parted], F.lit(False)))
    before = Window.partitionBy(*keys).orderBy(F.desc("slice_") if back else F.asc("slice_")).rowsBetween(Window.unboundedPreceding, -1)
    carried = some.groupBy("slice_", *keys).agg(*[add(f"v_{n}").alias(f"t_{n}") for n in totals])
    carried = carried.select("slice_", *keys, *[add(f"t_{n}").over(before).alias(f"c_{n}") for n in totals])  # a row for each slice and key
    own = Window.partitionBy("slice_", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = df.select("*", *[add(f"v_{n}").over(own).alias(f"h_{n}") for n in totals])
    out = _joined(here, carried, ["slice_", *keys], "left")
    return out.select(*kept, *[join(F.col(f"h_{n}"), F.col(f"c_{n}")).alias(n) for n in totals])


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "place", slices: int = SLICES, slice_: Column | None = None) -> DataFrame:
    """df with the place of each row in its key, from 1."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, slices=slices, slice_=slice_)


def magnitude(value: Column) -> Column:
    """A whole number that rises with value, one for each 64th of a doubling: ranges of values that need no sample."""
    size = F.floor(F.log2(F.abs(value)) * 64) + 100_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): exact medians of the values that aren't null. Counts by range find the ranges that hold a key's middle, only their values are counted one by one. Keys are few: samples or groups."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v_")).withColumn("slice_", magnitude(F.col("v_")))
    own = Window.partitionBy(*keys)
    per = rows.groupBy("slice_", *keys).agg(F.count(F.lit(1)).alias("n_"))  # a row for each range and key
    per = per.withColumn("all_", F.sum("n_").over(own)).withColumn("ahead_", F.sum("n_").over(own.orderBy("slice_").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_"))
    per = per.withColumn("low_", F.expr("(all_ + 1) div 2")).withColumn("high_", F.expr("all_ div 2 + 1"))
    middle = per.filter("ahead_ < high_ and ahead_ + n_ >= low_").drop("n_", "all_")  # two ranges a key at most
    some = _joined(rows, middle, ["slice_", *keys], "inner")
    each = some.groupBy("slice_", *keys, "v_", "ahead_", "low_", "high_").agg(F.count(F.lit(1)).alias("m_"))
    upto = F.col("ahead_") + F.sum("m_").over(Window.partitionBy("slice_", *keys).orderBy("v_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = {c: F.min(F.when(F.col("upto_") >= F.col(c), F.col("v_"))) for c in ("low_", "high_")}
    return each.withColumn("upto_", upto).groupBy(*keys).agg(((at["low_"] + at["high_"]) / 2).alias(name))
