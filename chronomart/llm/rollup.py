"""Token counts by source, language and tokenizer, kept up to date by signed deltas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Sum a batch of changes by key: what it adds to the totals.

    changes: source, lang, tokenizer, old_tokens and new_tokens. No old count is an insert, no new one a delete, both a
    revision, neither nothing. A document whose keys change is deleted under the old and inserted under the new ones.
    """
    docs = F.col("new_tokens").isNotNull().cast("long") - F.col("old_tokens").isNotNull().cast("long")
    tokens = F.coalesce(F.col("new_tokens"), F.lit(0)) - F.coalesce(F.col("old_tokens"), F.lit(0))
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


BUCKETS = 64
STATE = "doc_id long, source string, lang string, tokenizer string, tokens long"


def committed(spark: SparkSession, store: str) -> set[int]:
    """The numbers of all batches that the store holds, those folded into a compacted one too."""
    fs, p = _files(spark, f"{store}/batch=*/_SUCCESS")
    numbers = {int(x.getPath().getParent().getName().split("=")[1]) for x in fs.globStatus(p) or []}
    fs, p = _files(spark, f"{store}/commit=*/_batch=*")
    numbers |= {int(x.getPath().getName().split("=")[1]) for x in fs.globStatus(p) or []}
    fs, p = _files(spark, f"{store}/folded")
    return numbers | ({r.batch for r in spark.read.schema("batch long").parquet(f"{store}/folded").collect()} if fs.exists(p) else set())


def _place(spark: SparkSession, aside: str, place: str) -> bool:
    """Move a folder into its place as a whole; false, and no trace of it, if another writer was first. Needs a file system whose rename is atomic, which object stores are not."""
    fs, target = _files(spark, place)
    _, new = _files(spark, aside)
    if not fs.exists(target) and fs.rename(new, target):
        _, nested = _files(spark, f"{place}/{aside.rsplit('/', 1)[1]}")
        if not fs.exists(nested):
            return True
        fs.delete(nested, True)  # another writer was first, and ours was moved into its folder
    elif fs.exists(new):
        fs.delete(new, True)
    return False


def _newest(spark: SparkSession, store: str) -> tuple[int, dict[int, str]]:
    """The number of the last commit with a state, and for each bucket of documents the folder that has its newest rows."""
    fs, p = _files(spark, f"{store}/commit=*/_batch=*")
    numbers = sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in fs.globStatus(p) or [])
    buckets = {}
    for n in numbers:
        fs, p = _files(spark, f"{store}/commit={n}/state/bucket=*")
        buckets |= {int(x.getPath().getName().split("=")[1]): x.getPath().toString() for x in fs.globStatus(p) or []}
    return (numbers[-1] if numbers else 0), buckets


def state(spark: SparkSession, store: str, buckets: list[int] | None = None) -> DataFrame:
    """The counts by document as they are now (of some buckets only): doc_id, source, lang, tokenizer, tokens."""
    newest = _newest(spark, store)[1]
    paths = [path for b, path in newest.items() if buckets is None or b in buckets]
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def apply(spark: SparkSession, store: str, batch: int, puts: DataFrame, deletes: DataFrame | None = None) -> bool:
    """Bring the counts of some documents up to date, once: totals and state by document change together or not at all.

    puts (doc_id, source, lang, tokenizer, tokens): the rows that these documents have of a tokenizer from now on, all of them; deletes (doc_id,
    tokenizer): documents that have none of it any more. What they had comes from the stored state: a batch reads the buckets of its documents alone, takes
    off the rows that stand there, adds its own, and writes these buckets anew. Deltas, state and the batch's number lie in one folder that is moved into the next
    place of the store as a whole; of two writers one is first, and the other begins again on the first one's state. A batch that is committed changes
    nothing; what a broken attempt left beside the store never counts. Returns whether it was new.

    A null id, source or language is a value like others. Repeated rows of puts are documents of their own; a document both put and deleted is put.
    """
    kept = puts.select("doc_id", "source", "lang", "tokenizer", "tokens")
    keys = kept.select("doc_id", "tokenizer")
    keys = (keys if deletes is None else keys.unionByName(deletes.select("doc_id", "tokenizer"))).distinct().withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    while batch not in committed(spark, store):
        aside = f"{store}/.new-{uuid.uuid4().hex}"
        last, newest = _newest(spark, store)
        touched = sorted(r[0] for r in keys.select("_bucket").distinct().collect())  # at most BUCKETS
        old = state(spark, store, [b for b in touched if b in newest])
        on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("tokenizer").eqNullSafe(F.col("_tokenizer"))
        named = keys.select(F.col("doc_id").alias("_id"), F.col("tokenizer").alias("_tokenizer"))
        signed(document_changes(kept, old.join(named, on, "left_semi"))).write.parquet(f"{aside}/delta")
        now = old.join(named, on, "left_anti").unionByName(kept).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
        now.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{aside}/state")
        for b in touched:  # a bucket may have lost all its documents
            fs, p = _files(spark, f"{aside}/state/bucket={b}")
            fs.mkdirs(p)
        fs, p = _files(spark, f"{aside}/_batch={batch}")
        fs.create(p, True).close()
        if _place(spark, aside, f"{store}/commit={last + 1}"):
            return True
    return False


def is_committed(spark: SparkSession, store: str, batch: int) -> bool:
    return batch in committed(spark, store)


def commit(spark: SparkSession, store: str, batch: int, changes: DataFrame) -> bool:
    """Add a batch's deltas to the store once: a batch that is committed already changes nothing.

    The deltas are written beside the store and moved into it as a whole, which succeeds for one writer only: of two that commit a
    batch at once, one wins and the other changes nothing. What an interrupted commit left beside the store never counts, so a
    commit may be repeated at any time. Returns whether it was new.
    """
    if is_committed(spark, store, batch):
        return False
    aside = f"{store}/.new-{uuid.uuid4().hex}"
    signed(changes).write.parquet(aside)
    return _place(spark, aside, f"{store}/batch={batch}")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """The current totals: the sum of all committed deltas; keys whose documents are all gone are left out.

    Null sources, languages and tokenizers are keys of their own; a store without batches gives an empty table.
    """
    fs, p = _files(spark, f"{store}/batch=*/_SUCCESS")
    paths = sorted(x.getPath().getParent().toString() for x in fs.globStatus(p) or [])
    fs, p = _files(spark, f"{store}/commit=*/delta")
    paths += sorted(x.getPath().toString() for x in fs.globStatus(p) or [])
    deltas = spark.read.schema(DELTA).parquet(*paths) if paths else spark.createDataFrame([], DELTA)
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


def compact(spark: SparkSession, store: str, batch: int) -> str:
    """Fold all committed batches into one of the given number in a new store, which takes this one's place: store + '-compact-' and the number.

    It knows the numbers of the folded batches, so none of them can be committed again. Returns the new store.
    """
    new = f"{store}-compact-{batch}"
    done = sorted(committed(spark, store))
    if batch in done:
        raise ValueError(f"batch {batch} is committed already")
    spark.createDataFrame([(b,) for b in done], "batch long").write.mode("overwrite").parquet(f"{new}/folded")
    totals(spark, store).write.mode("overwrite").parquet(f"{new}/batch={batch}")
    last, newest = _newest(spark, store)
    if newest:
        now = state(spark, store).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
        now.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{new}/commit={last}/state")
        fs, p = _files(spark, f"{new}/commit={last}/_batch={batch}")
        fs.create(p, True).close()
    return new


def document_changes(counts: DataFrame, state: DataFrame) -> DataFrame:
    """The changes that bring the counts by document of a state to those of the present: what commit() takes, and apply() derives from its stored state.

    Both: source, lang, tokenizer, tokens, one row a document and tokenizer (and any other columns). Every row of the state leaves with the count
    it came with, and every row of the present comes with its own: what is in both cancels in the sums, so nothing has to be matched by
    document, and only what a batch touches need be passed. Repeated rows are documents of their own; nulls are values like others.
    """
    none = F.lit(None).cast("long")
    of = lambda d, old, new: d.select(*KEYS, old.alias("old_tokens"), new.alias("new_tokens"))
    return of(state, F.col("tokens"), none).unionByName(of(counts, none, F.col("tokens")))
