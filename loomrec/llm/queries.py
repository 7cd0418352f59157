"""The queries of this subpackage: one for each operator, over its whole table and with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files lie: LOOMREC_TOKENIZERS, or the installed package's folder."""
    folder = os.environ.get("LOOMREC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.ngram_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.quality_rules import judge

    verdicts = judge(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.suffix_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"))
    # The remaining bytes as a text: a cut within a character leaves U+FFFD.
    return done.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.chat_format import digests, format_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    return digests(format_turns(rows))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.quality_classifier import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    scored = score(docs, train(docs, labels.where(~held_out)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.line_dedup import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return done.select("doc_id", n_lines.alias("n_lines"), "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.lm_scoring import Model, score

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    scored = score(docs, Model(docs, ~held_out, tokenizer_path("piece_bpe_32k.model")))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.token_alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrec.llm.source_divergence import audit

    return audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_join, op2_quality_rules, op3_best_fit_packing, op4_source_mixing, op5_suffix_dedup, op6_embedding_dedup, op7_chat_format, op8_html_extract, op9_quality_classifier, op10_line_dedup, op11_lm_scoring, op12_token_alignment, op13_source_divergence)
}
