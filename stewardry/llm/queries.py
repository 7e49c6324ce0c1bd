"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import checks, curve_packing, decontam, importance, langid, line_dedup, markov, merkle, ngram_join, packing, secrets, sharding, spotsigs, suffix_dedup
from stewardry.llm.common import documents

SHARDS = 40


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(modulus: int) -> Column:
    """A document's fold: CRC-32 of its id as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op2_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.train(docs), keep=(F.col("doc_id"),))

    def joined(where: str) -> Column:
        return F.expr(f"array_join(transform(filter(spans, x -> {where}), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")

    def number(kind: str) -> Column:
        return F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(kind) for kind in secrets.KINDS[:3]),
        F.sha2(joined("x.kind != 'crf'"), 256).alias("base_sha256"),
        joined("true").alias("spans"),
        number("crf"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row_tag")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.near_duplicates(documents(spark, sf_dir), ngram=3, similarity=(90, 100))
    return joined.select("doc_id", "n_shingles", "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_gone", F.sha2("kept", 256).alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer=tokenizer_path())


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(5) == 0
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs, model, keep=(F.col("doc_id"), held_out.alias("held_out")))


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edits(documents(spark, sf_dir))


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.score_texts(documents(spark, sf_dir), fold(7) == 2)


def op10_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.interleave(documents(spark, sf_dir), SHARDS)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("stratum").alias("source"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


def op13_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack_along_curve(documents(spark, sf_dir), tokenizer=tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secret_field": op2_secret_field,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_mixture": op7_language_mixture,
    "op8_spot_signatures": op8_spot_signatures,
    "op9_hidden_markov": op9_hidden_markov,
    "op10_stratified_sharding": op10_stratified_sharding,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hilbert_packing": op13_hilbert_packing,
}

#: No entry for the others: tokenizers, trained models, suffix order and graph components are not in DuckDB's SQL, or take
#: it too long on whole tables. Those queries are held against brute force in tests/llm.
CHECKS: dict[str, str] = {
    "op11_importance_resampling": checks.IMPORTANCE,
    "op12_merkle_manifest": checks.MERKLE,
}
