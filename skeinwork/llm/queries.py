"""The numbered queries op1 to op13 over the shared tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import audit, chat, embed, exact, langid, minhash, pii, quality, secrets, sharding, spelling, tokens

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def counted(spans: str, field: str, value: str | int) -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd))
    back = chats.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.trained_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        text_sha256(whole).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        text_sha256(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path()).withColumnRenamed("id", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(table(spark, sf_dir, "documents"), vocabulary_path()).withColumnRenamed("id", "doc_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(spans: Column) -> Column:
        kinds = F.array(*map(F.lit, pii.KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.rank + 1), s.start, s.end)), ",")

    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [counted("base", "rank", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    every = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s.start.alias("start"), s.rank.alias("rank"), s.end.alias("end"))), F.transform("terms", lambda t: F.struct(t.start.alias("start"), F.lit(len(pii.KINDS)).alias("rank"), t.end.alias("end")))))
    kinds = F.array(*map(F.lit, [*pii.KINDS, "term"]))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(kinds, s.rank + 1), s.start, s.end)), ",")
    return found.select(F.col("id").alias("doc_id"), *counts, text_sha256(named(F.col("base"))).alias("base_sha256"), spans.alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    counts = [counted("spans", "kind", kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    base = F.filter("spans", lambda s: s.kind != secrets.KINDS[3])
    return found.select(F.col("id").alias("doc_id"), *counts, text_sha256(named(base)).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "p_text", "p_meta", "score", "kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~held_out()))
    found = langid.predict(docs.select("doc_id", "text"), net)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SHARDS = 24


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_chat_format, op2_minhash_dedup, op3_bpe_codec, op4_packing, op5_pii, op6_secret_scan, op7_embedding_dedup,
        op8_quality, op9_exact_dedup, op10_language_id, op11_filter_audit, op12_sharding, op13_spelling_variants,
    )
    return {f.__name__: f for f in named}
