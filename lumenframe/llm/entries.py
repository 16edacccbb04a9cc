"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, exact_dedup, langid, media, minhash, packing, pii, repeats, sharding, spelling, toxicity
from .common import blanks_removed, fold, table, text_of

#: The setting that names a text file with the key of the pseudonyms on its first line.
#: The key then stands in no setting, plan or event log.
KEY_FILE = "spark.lumenframe.pseudonymKeyFile"
#: A published key, for tests and demonstrations only.
TEST_KEY = "lumenframe-demo-key"


def pseudonym_key(spark: SparkSession, default: str | None = None) -> str | Column:
    """The key in the file that the setting names; without the setting, the default, or
    an error if there is none."""
    path = spark.conf.get(KEY_FILE, None)
    if path:
        return spark.read.text(path, wholetext=True).select(F.substring_index("value", "\n", 1)).scalar()
    if default is None:
        raise ValueError(f"set {KEY_FILE} to a file with the key of the pseudonyms")
    return default


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the bytes that decoding them gives."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, pattern).drop("text")
    return bpe.decode(ids, ranks, pattern).select(
        "doc_id", bpe.token_count("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = langid.predict(docs, langid.fit(docs))
    return got.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    got = toxicity.score(docs, model)
    return got.select(
        "doc_id", fold(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are code points; copies of one text, white space aside, are a cluster."""
    docs, text = table(spark, sf_dir, "documents"), text_of("text")
    return packing.pack(docs, F.char_length(text), F.col("source"), F.xxhash64(blanks_removed(text)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pseudonym_key(spark, TEST_KEY), count_cols=True)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, with digests read back from the output."""
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_back(chat.format_chats(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textures of all embeddings and edited copies of every fiftieth; those are queries."""
    every_fiftieth = F.col("vec_id") % 50 == 0
    images = media.images_of(table(spark, sf_dir, "embeddings"), every_fiftieth)
    return media.find_copies(images, (F.col("edit") == "none") & (F.col("image_id") % 50 == 0))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the aligned groups of both public tokenizers, and the measures."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    got = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), *paths, digest=True)
    return got.withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_minhash, op2_bpe, op3_packing, op4_exact_dedup, op5_langid, op6_pii, op7_toxicity, op8_chat_format, op9_media, op10_sharding, op11_spelling, op12_suffix_dedup, op13_alignment)}
SQL = {"op1_minhash": minhash.SQL, "op4_exact_dedup": exact_dedup.SQL, "op8_chat_format": chat.SQL, "op11_spelling": spelling.SQL, "op12_suffix_dedup": repeats.SQL}
