"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import (
    chat, decontaminate, packing, pii, repair, secrets, simhash, spelling, token_counts, toxicity, trie_join,
    vector_search, whitening,
)
from chalkline.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_repair_ids(spark, sf_dir):
    path = shared_dir(spark, "token-shards")
    repair.write_shards(_table(spark, sf_dir, "documents"), path)
    return repair.read_documents(spark, path)


@query
def op2_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, F.lit(False))
    return toxicity.with_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op3_vector_search(spark, sf_dir):
    return vector_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def sized(docs: DataFrame) -> DataFrame:
    """Documents as the packer takes them: sizes in bytes, one cluster for texts that agree in their words."""
    words = F.regexp_replace(F.lower(F.trim(F.coalesce("text", F.lit("")))), r"\s+", " ")
    return docs.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), "source",
        F.xxhash64(words).alias("cluster"),
    )


@query
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(sized(_table(spark, sf_dir, "documents")))


@query
def op5_chat_format(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], turns.schema)
    events = chat.turns_as_events(turns.unionByName(extra))
    out = chat.render(chat.fold_events(events)).withColumn("turns", chat.read_turns(F.col("formatted")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss_text", chat.loss_text(F.col("formatted"), F.col("loss")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(digest, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode("loss_text", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op6_secrets(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.fit(secrets.labelled_samples(docs))
    found = secrets.with_secrets(docs, model)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query
def op7_simhash_components(spark, sf_dir):
    found = simhash.with_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_pii(docs).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


@query
def op9_decontamination(spark, sf_dir):
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op10_token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op11_ngram_join(spark, sf_dir):
    return trie_join.with_components(_table(spark, sf_dir, "documents"))


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents")))
