"""A kept index of tagged tables, so that a search reads the wanted keys and rows instead of all tables.

The index is three tables of the session's catalog, all in buckets, so none is shuffled when a search joins it:

* ``postings(key_hash, row)``, bucketed by ``key_hash``: which text rows offer a key;
* ``rows(row, same, scope, texts)``, bucketed by ``row``: the distinct texts of rows, which a search compares. However many
  rows and files hold them, their keys are made and kept once;
* ``places(row, same, file_id, table_full_name, row_id, n_rows)``, bucketed by ``row``: the rows that hold the texts.
  Equal rows of a file are one entry with their number.

Files of governed tables never change, so a refresh adds the entries of files it has not seen, and forgets files that are
gone by leaving them out of ``files``; making the index anew drops what is forgotten. The row texts are personal data: the
index belongs where the tables are, and after an erasure it is made anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stewardry.operators.search import (
    FUZZY_THRESHOLD,
    KEY_KINDS,
    KeyUse,
    Scope,
    direct_requests,
    direct_scopes,
    kept_hits,
    normalise_subjects,
    offered_keys,
    question_keys,
    questions,
    row_id,
    row_texts,
    scored_hits,
    spec_hash,
    text_entries,
    text_hashes,
    text_rows,
)
from stewardry.session import materialise

#: Buckets of each table of a new index.
INDEX_BUCKETS = 64
#: Keys that a search puts into its filter as values, which lets Spark read their buckets only. With more keys all buckets
#: hold some of them, and the join alone picks them.
LISTED_KEYS = 2_000


@dataclass(frozen=True)
class SearchIndex:
    """Names of an index's tables, the folder they lie in, and how its texts were made."""

    name: str
    folder: str
    fold: bool = True
    buckets: int = INDEX_BUCKETS

    @property
    def postings(self) -> str:
        return f"{self.name}_postings"

    @property
    def rows(self) -> str:
        return f"{self.name}_rows"

    @property
    def places(self) -> str:
        return f"{self.name}_places"

    @property
    def files(self) -> str:
        return f"{self.name}_files"


def _file_id(path: Column) -> Column:
    return F.xxhash64(path)


def _scope_rows(df: DataFrame, scope: Scope, fold: bool, primary_key: Sequence[str] | None) -> DataFrame:
    """One table's rows with their texts and the file that each is from."""
    rows = df.select(
        _file_id(F.col("_metadata.file_path")).alias("file_id"),
        F.lit(scope.table).alias("table_full_name"),
        row_id(df, primary_key).alias("row_id"),
        F.lit(scope.name).alias("scope"),
        text_entries(row_texts(df, scope, fold)).alias("texts"),
    )
    return rows.withColumns(text_hashes())


def _every_use(scopes: Sequence[Scope]) -> list[KeyUse]:
    """Every kind of key of every tag: an index is asked later."""
    return sorted({KeyUse(s.name, tag, kind) for s in scopes for tag, _ in s.columns for kind in KEY_KINDS[tag]}, key=str)


def _table_files(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("table_full_name"), F.col("_metadata.file_path").alias("path")).distinct() for name, df in tables.items()]
    files = reduce(DataFrame.unionByName, parts)
    return files.withColumn("file_id", _file_id(F.col("path")))


def _exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def _append(df: DataFrame, index: SearchIndex, table: str, key: str) -> None:
    dealt = df.repartition(index.buckets, key)  # one file a bucket and refresh
    writer = dealt.write.bucketBy(index.buckets, key).sortBy(key).mode("append").format("parquet")
    writer.option("path", f"{index.folder}/{table}").saveAsTable(table)


def refresh(
    index: SearchIndex,
    tables: Mapping[str, DataFrame],
    column_tags: DataFrame,
    primary_keys: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, int]:
    """Bring the index up to the files that ``tables`` (read from files) have now; returns files ``added`` and ``gone``.

    Only files that the index has not seen are read. A table's tags are taken as they are; where they change, the
    index is to be made anew.
    """
    spark = column_tags.sparkSession
    scopes = direct_scopes(column_tags, tables)
    now = materialise(_table_files({s.table: tables[s.table] for s in scopes}), "files")
    seen = spark.table(index.files) if _exists(spark, index.files) else now.limit(0)
    new = materialise(now.join(seen, "file_id", "left_anti"), "new-files")
    gone = seen.join(now, "file_id", "left_anti").count()
    added = dict(new.groupBy("table_full_name").count().collect())
    sides = []
    for scope in scopes:
        if scope.table in added:
            paths = [r["path"] for r in new.filter(F.col("table_full_name") == scope.table).select("path").collect()]
            df = spark.read.schema(tables[scope.table].schema).parquet(*paths)
            sides.append(_scope_rows(df, scope, index.fold, (primary_keys or {}).get(scope.table)))
    if sides:
        rows = reduce(DataFrame.unionByName, sides)
        texts = text_rows(rows)
        if _exists(spark, index.rows):
            texts = texts.join(spark.table(index.rows).select("row", "same"), ["row", "same"], "left_anti")
        texts = materialise(texts, "texts")
        # Texts count as known once they are in ``rows``, so their keys are written before them.
        _append(texts.select(F.explode(offered_keys(_every_use(scopes))).alias("key_hash"), "row"), index, index.postings, "key_hash")
        _append(texts, index, index.rows, "row")
        place = ["row", "same", "file_id", "table_full_name", "row_id"]
        _append(rows.groupBy(*place).agg(F.count("*").alias("n_rows")), index, index.places, "row")
    # The list of files is replaced last: entries of a refresh that failed are not listed, so they are never read twice.
    listed = materialise(now, "files")
    spark.sql(f"DROP TABLE IF EXISTS {index.files}")
    listed.write.mode("overwrite").format("parquet").option("path", f"{index.folder}/{index.files}").saveAsTable(index.files)
    return {"added": sum(added.values()), "gone": gone}


def drop(index: SearchIndex, spark: SparkSession) -> None:
    for table in (index.postings, index.rows, index.places, index.files):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _postings_of(index: SearchIndex, keys: DataFrame) -> DataFrame:
    """Postings with one of ``keys(key_hash, ..)``."""
    spark = keys.sparkSession
    postings = spark.table(index.postings)
    wanted = [r["key_hash"] for r in keys.select("key_hash").distinct().limit(LISTED_KEYS + 1).collect()]
    if len(wanted) <= LISTED_KEYS:
        postings = postings.filter(F.col("key_hash").isin(wanted))
    return postings.join(keys, "key_hash")


def search_index(
    index: SearchIndex,
    subjects: DataFrame,
    tables: Mapping[str, DataFrame],
    column_tags: DataFrame,
    nicknames: DataFrame,
    threshold: float | None = FUZZY_THRESHOLD,
) -> DataFrame:
    """What :func:`~stewardry.operators.search.search_tables` finds, from the index; ``tables`` names those to search.

    The keys of the questions meet the postings, what is left meets the texts, and the texts that hold meet the rows of live
    files. The tables of the index are joined in their buckets, so neither postings, texts nor rows are shuffled.
    """
    spark = column_tags.sparkSession
    scopes = direct_scopes(column_tags, tables)
    requests = direct_requests(materialise(normalise_subjects(subjects), "identifiers"), scopes)
    members, specs = questions(requests, nicknames)
    specs = materialise(specs, "specs")
    keys = materialise(question_keys(specs).select("spec_id", "key_hash").distinct(), "keys")
    pairs = materialise(_postings_of(index, keys).select("row", spec_hash()).distinct(), "pairs")
    scored = scored_hits(spark.table(index.rows), pairs, specs)
    live = spark.table(index.places).join(spark.table(index.files).select("file_id"), "file_id", "left_semi")
    return kept_hits(scored, live, members, threshold).drop("scope")
