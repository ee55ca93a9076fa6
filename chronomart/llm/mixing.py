"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACE_RUN, SPACES, written

#: Finish times are summed on a grid of so many cells a unit, then on as many again within the cell that holds the cut.
CELLS = 4096


def word_count(text: Column) -> Column:
    flat = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, SPACE_RUN))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Share the total of all sizes among sources by weight; no target exceeds `most` times its source's size.

    sizes: no_source boolean, source string, source_size long, one row a source. Sources in code point order, null
    last, take the weights in turn. Sources whose cap lies below their share form a prefix in order of cap / weight;
    what they leave goes to the others by weight. Adds weight int and target double.
    """
    order = Window.orderBy("no_source", "source")
    by_cap = Window.orderBy("ratio", "no_source", "source")
    place = F.row_number().over(order) - 1
    d = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    d = d.withColumn("cap", (most * F.col("source_size")).cast("long")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns(
        {
            "left_over": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    d = d.withColumn("capped", F.col("cap") * F.col("weights") <= F.col("weight") * F.col("left_over"))
    free = F.sum("source_size").over(every) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    free_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    share = F.col("weight") * free.cast("double") / F.greatest(free_weight, F.lit(1))
    return d.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).select("no_source", "source", "source_size", "weight", "target")


def _shuffle_key() -> Column:
    """The MD5 of the id, or of the text's where there is no id, so that documents without ids spread like others."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), text)).cast("binary"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Take documents, some of them up to `most` times, so that each source's words come near its target.

    Within a source, documents stand in the order of the MD5 of their id (a shuffle that every run repeats) and are
    queued once, then again, up to `most` times. A document's virtual finish time is its source's words up to its end,
    divided by the source's target, so that all sources reach their targets together. All queues are merged by
    finish time and cut where the total budget (the sum of all sizes) is used up.

    Prefix sums are taken in two levels (hash buckets, then rows of a bucket), and the cut is found on a grid of
    summed finish times, so no task orders a whole source or the whole queue.

    Null texts have size 0 and are taken zero words; a null source is a source of its own; documents
    without ids are shuffled by their texts; repeated rows are separate documents; ties in finish time go by source, shuffle, id and round; other
    columns are left out; an empty table gives an empty table.

    Returns doc_id, source, size, source_size long, target double, copies int, taken long, h string (the shuffle's key).
    """
    key = _shuffle_key()
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), word_count(F.col("text")).alias("size"), key.alias("h"),
    ).withColumn("bucket", F.substring("h", 1, 3))
    d = written(d, "mix-sizes")
    by_bucket = d.groupBy("no_source", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    own = Window.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(own), F.lit(0))).drop("bucket_size")
    targets = source_targets(d.groupBy("no_source", "source").agg(F.sum("size").alias("source_size")), weights, most)
    start = by_bucket.join(targets, ["no_source", "source"])
    inside = Window.partitionBy("no_source", "source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(start, ["no_source", "source", "bucket"]).withColumn("end", F.col("before") + F.sum("size").over(inside))
    d = written(d.select("doc_id", "no_source", "source", "size", "h", "source_size", "target", "end"), "mix-queue")

    finish = lambda k: (F.col("end") + k * F.col("source_size")).cast("double") / F.col("target")
    copies = d.filter("size > 0 and target > 0").select("*", F.explode(F.array(*map(F.lit, range(most)))).alias("round"))
    copies = copies.withColumn("finish", finish(F.col("round")))
    budget = d.agg(F.sum("size")).first()[0] or 0

    def cell_of_cut(rows: DataFrame, cell: Column, used: int) -> tuple[int | None, int]:
        """The first cell at whose end the budget is exceeded, and what is used before it; at most CELLS + 1 cells come here."""
        for c, n in rows.groupBy(cell.alias("cell")).agg(F.sum("size")).orderBy("cell").collect():
            if used + n > budget:
                return c, used
            used += n
        return None, used

    outer = F.least(F.floor(F.col("finish") * CELLS), F.lit(2 * CELLS))
    at, used = cell_of_cut(copies, outer, 0)
    order = ["finish", "no_source", "source", "h", "doc_id", "size", "round"]
    last = None
    if at is not None:
        rows = copies.filter(outer == at)
        if at < 2 * CELLS:
            fine = F.floor(F.col("finish") * CELLS * CELLS)
            inner, used = cell_of_cut(rows, fine, used)
            rows = rows.filter(fine == inner)
        run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        fits = rows.withColumn("run", run).filter(F.col("run") + used <= budget)
        last = fits.orderBy(*[F.desc(c) for c in order]).select(*order).first()
    if at is None:
        taken = F.lit(most)
    else:
        edge = (at if at >= 2 * CELLS else None, inner if at < 2 * CELLS else None)

        def one(k: int) -> Column:
            f = finish(F.lit(k))
            early = F.floor(f * CELLS * CELLS) < edge[1] if edge[1] is not None else F.floor(f * CELLS) < edge[0]
            if last is None:
                return early.cast("int")
            mine = F.struct(f.alias("finish"), *[F.col(c) for c in order[1:-1]], F.lit(k).alias("round"))
            kinds = {"finish": "double", "no_source": "boolean", "doc_id": "long", "size": "long", "round": "int"}
            cut = F.struct(*[F.lit(last[c]).cast(kinds.get(c, "string")).alias(c) for c in order])
            return (early | (mine <= cut)).cast("int")

        taken = sum((one(k) for k in range(1, most)), one(0))
    n = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0)
    out = d.withColumn("copies", n.cast("int"))
    return out.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "h",
    )


def apply_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it.

    A row finds its document by id (or, without one, by text), source and size; documents alike in all these come as often as the one of
    them that is taken most. Rows that the mix takes no words of go; an empty table stays empty; columns of any other name pass through.
    """
    copies = mix.groupBy("h", "doc_id", "source", "size").agg(F.max("copies").alias("_copies")).filter("_copies > 0").toDF("_h", "_id", "_source", "_size", "_copies")
    own = docs.withColumns({"_k": _shuffle_key(), "_n": word_count(F.col("text"))})
    match = (F.col("_k") == F.col("_h")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    joined = own.join(copies, match).withColumn("_round", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return joined.select(*docs.columns)
