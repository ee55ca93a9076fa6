"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, lm, minhash, mixing, negatives, pii, quality, rollup, runs, topk, toxicity, warc
from ._shared import new_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two tokenizers over all documents, then a revision of one for low-quality documents and the deletion of toxic ones; some batches are sent twice.

    A batch says what its documents have from now on; what they had comes from the state by document that is stored with the totals.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counted = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")).cast("long").alias("pieces"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]{2,}")).cast("long").alias("long_words"),
    )
    counted = written(counted.join(labels, "doc_id", "left"), "counts")  # texts are counted before the join, so they are not shuffled
    row = lambda version, tokens: F.struct(F.lit(version).alias("tokenizer"), tokens.alias("tokens"))

    def counts(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "source", "lang", F.explode(F.array(row("words", F.col("words")), row("pieces", F.col("pieces")))).alias("c")).select("doc_id", "source", "lang", "c.*")

    low, gone, store = counted.filter("quality = 0"), counted.filter("toxic = 1"), new_folder(spark, "rollup")
    both = F.explode(F.array(F.lit("words"), F.lit("pieces"))).alias("tokenizer")
    batches = {
        1: (counts(counted).filter("tokenizer = 'words'"), None), 2: (counts(counted).filter("tokenizer = 'pieces'"), None),
        3: (counts(low.withColumn("words", F.col("long_words"))).filter("tokenizer = 'words'"), None), 4: (counts(gone).limit(0), gone.select("doc_id", both)),
    }
    for batch in (1, 2, 3, 3, 4, 2):
        rollup.apply(spark, store, batch, *batches[batch])
    return rollup.totals(spark, store)


def op5_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), order=3)


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_chats(chat.turn_costs(rows, public_tokenizers.path("byte_bpe_50k.json"))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars"
    )


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(pii.find_candidates(table(spark, sf_dir, "documents")), "spans")
    _, weights = pii.fit(found)
    kept = pii.classify(found, weights)
    names = F.array(*map(F.lit, pii.KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    n = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return kept.select(
        "doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
        F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = runs.periodic_runs(runs.repeated_tail(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    d = d.withColumn("best", best).withColumns({"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period")})
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return read.filter("record_type in ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_bpe_round_trip, op2_near_duplicates, op3_mix_sources, op4_token_rollup, op5_pivot_top_k,
        op6_lm_scores, op7_chat_windows, op8_toxicity, op9_quality_rules, op10_pii_spans, op11_hard_negatives, op12_periodic_runs, op13_warc, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL
