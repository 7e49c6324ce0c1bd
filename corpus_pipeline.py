"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last return the
columns of ``documents``:

1. language ID drops documents in no learned language (no text, or no letter in it);
2. line dedup takes repeated lines out of the texts, and drops documents that had text and have none left;
3. the n-gram Jaccard join keeps one document of each group of near duplicates, the one with the smallest id
   (of several texts under it, the one with the smallest tag);
4. benchmark decontamination drops documents that hold a benchmark item;
5. best-fit packing places the tokens of the rest into sequences.

``run`` writes each stage's rows and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import decontam, langid, line_dedup, ngram_join, packing
from stewardry.llm.common import text_tag
from stewardry.llm.queries import tokenizer_path
from stewardry.session import materialise, release, scratch

#: Near duplicates share four fifths of their five-word shingles at least.
NGRAM = 5
SIMILARITY = (80, 100)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language. The labels in ``lang`` are learned from and left as they are."""
    model = langid.train(docs)
    found = langid.identify(docs, model, keep=tuple(F.col(c) for c in docs.columns))
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out; ``n_chars`` is counted anew where lines went."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = line_dedup.drop_repeated_lines(docs, keep=others)
    kept = kept.filter((F.col("n_gone") == 0) | (F.length(F.trim("kept")) > 0))
    kept = kept.withColumn("n_chars", F.when(F.col("n_gone") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
    return kept.withColumnRenamed("kept", "text").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: the text that names it. Documents without words all stay.

    A row is known by its id and its text, so NULL or repeated ids neither join nor part groups.
    """
    joined = ngram_join.near_duplicates(docs, ngram=NGRAM, similarity=SIMILARITY)
    wordless = F.col("n_shingles") == 0
    named = joined.filter(wordless | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_tag") == F.col("component_tag"))))
    chosen = named.select(F.col("doc_id").alias("_id"), F.col("row_tag").alias("_tag"), wordless.alias("_wordless")).distinct()
    rows = docs.withColumn("_row_tag", text_tag(F.col("text")))
    kept = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["_id"]) & (rows["_row_tag"] == chosen["_tag"]))
    kept = kept.withColumn("_each", F.when(F.col("_wordless"), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc_id", "_row_tag", "_each"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, and no others under their id."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = materialise(found.select(F.col("doc_id").alias("_bad"), F.col("row_tag").alias("_bad_tag")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & (text_tag(F.col("text")) == F.col("_bad_tag")), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer=tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: No stage but the first could be written in DuckDB's SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each one's intermediate tables go when it has been written, and its rows when the next one has."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch(spark) as used:
            docs = used.keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        release(spark, before)
        before = [docs.scratch_path]
    return docs
