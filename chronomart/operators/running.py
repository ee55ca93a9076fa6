"""Running values of long series without a task that holds a whole series: blocks of the order, and what earlier blocks carry into each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def cells(c: Column, per_unit: int = 64) -> Column:
    """A cell for each value that grows with it, of even width in the logarithm of its size: blocks for an order by value. NaN comes last, as in Spark's order."""
    c = c.cast("double")
    return F.floor(F.when(F.isnan(c), float("inf")).otherwise(F.signum(c) * F.log1p(F.abs(c)) * per_unit))


def running(d: DataFrame, key: list[str], order: list[str], block: int | Column | None, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """d with running values over each key in `order`. columns: name -> (kind, value), where kind is

    sum, max or last: of the rows so far, this one too, nulls left out; max_before: of the rows before this one; previous: the value of the
    row before, null or not; total: the sum over the whole key.

    `block` deals a key over tasks: rows of one floor(order[0] / block) are one task's, or of one value of a column that grows with the order;
    None takes a key as one block. Each block is summed up to one row, windows over those rows give what earlier blocks carry, and that
    comes into the block as its first row. `order` must be total; among equal positions the choice of last and previous is Spark's. A
    null key is a key like others, a null position comes first. Columns of d that have the name of a new one are replaced.
    """
    at = F.lit(0) if block is None else block if isinstance(block, Column) else F.floor(F.col(order[0]) / block)
    kept = [c for c in d.columns if c not in columns]
    kinds, values = {n: k for n, (k, _) in columns.items()}, {n: c for n, (_, c) in columns.items()}
    x = {n: f"_x{i}" for i, n in enumerate(columns)}
    rows = d.select(F.struct(*key).alias("_key"), at.alias("_b"), F.struct(*order).alias("_o"), F.struct(*kept).alias("_row"), *[F.struct(c.alias("v")).alias(x[n]) if kinds[n] == "previous" else c.alias(x[n]) for n, c in values.items()])
    if block is not None or "total" in kinds.values():
        one = {
            "sum": F.sum, "total": F.sum, "max": F.max, "max_before": F.max, "previous": lambda c: F.max_by(c, "_o"),
            "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))),
        }
        each, whole = Window.partitionBy("_key").orderBy("_b"), Window.partitionBy("_key")
        earlier = each.rowsBetween(Window.unboundedPreceding, -1)
        over = {
            "sum": lambda c: F.sum(c).over(earlier), "total": lambda c: F.sum(c).over(whole), "max": lambda c: F.max(c).over(earlier), "max_before": lambda c: F.max(c).over(earlier),
            "previous": lambda c: F.last(c).over(earlier), "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
        }
        carried = rows.groupBy("_key", "_b").agg(*[one[kinds[n]](x[n]).alias(x[n]) for n in columns]).select("_key", "_b", *[over[kinds[n]](x[n]).alias(x[n]) for n in columns])
        rows = rows.withColumn("_f", F.lit(1)).unionByName(carried.withColumn("_f", F.lit(0)), allowMissingColumns=True)
    else:
        rows = rows.withColumn("_f", F.lit(1))
    w = Window.partitionBy("_key", "_b").orderBy("_f", "_o")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    inside = {
        "sum": lambda c: F.sum(c).over(so_far), "max": lambda c: F.max(c).over(so_far), "max_before": lambda c: F.max(c).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(so_far),
        "previous": lambda c: F.lag(c).over(w)["v"], "total": lambda c: F.first(c).over(so_far),
    }
    out = rows.select("_f", "_row", *[inside[kinds[n]](x[n]).alias(n) for n in columns])
    return out.filter("_f = 1").select("_row.*", *columns)


def overlapped(d: DataFrame, key: list[str], at: str, block: int, before: int, after: int = 0) -> tuple[DataFrame, WindowSpec]:
    """d dealt into blocks of `block` positions of `at`, each with the rows up to `before` positions ahead of it and `after` behind it, and a window over a block.

    Frames of at most `before` preceding and `after` following rows see all their rows there, if no two rows of a key share a position; take
    own(d) after them. A hot key is many tasks' work. For rows without even steps number them first (numbered).
    """
    if not (block >= before and block >= after):
        raise ValueError("a block must hold the overlap")
    of = lambda x: F.floor(x / block)
    b = of(F.col(at))
    d = d.withColumn("_own", b).withColumn("_b", F.explode(F.array_distinct(F.array(b, of(F.col(at) + before), of(F.col(at) - after)))))
    return d, Window.partitionBy(*key, "_b").orderBy(at)


def own(d: DataFrame) -> DataFrame:
    """The rows of each block itself."""
    return d.filter("_own = _b").drop("_own", "_b")


def numbered(d: DataFrame, key: list[str], order: list[str], block: int | Column | None, name: str = "k") -> DataFrame:
    """d with the number of each row within its key, from 0, taken in blocks."""
    return running(d, key, order, block, {name: ("sum", F.lit(1))}).withColumn(name, F.col(name) - 1)
