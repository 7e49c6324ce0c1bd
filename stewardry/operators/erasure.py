"""Erase selected rows with an all-or-nothing check, keep evidence, and restore from a snapshot.

Files are immutable, so erasing yields the surviving rows; publishing them is a separate write to a
fresh folder. Selected rows are matched by null-safe equality on typed columns: the declared
primary key, or all columns where none is declared.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from stewardry.functions.durations import at, retention_days, retention_text
from stewardry.functions.hashing import hash_row_key, hash_subject_ref, row_text
from stewardry.operators.lifecycle import table_property
from stewardry.session import exists, materialise, release, scratch_folder

# --- fixed values --------------------------------------------------------------------------
RETENTION_PROPERTY = "delta.deletedFileRetentionDuration"
BY_KEY, BY_ROW = "primary_key", "full_row_equality"
SUCCEEDED, FAILED, ABORTED = "SUCCEEDED", "FAILED", "ABORTED"
COMPLETED, PARTIAL, PENDING = "COMPLETED", "PARTIAL", "PENDING"
# -------------------------------------------------------------------------------------------

ABORTED_BY_OTHER = "Another table of the request did not pass its check, so no table of it was touched."

#: Row hashes of one item are stored in arrays of about this many; more make further chunks.
HASHES_PER_CHUNK = 10_000

_TARGET = ["request_id", "provenance", "matched_on"]

#: Stored arrays of packed hashes, by the column of the long form.
_STORED = {"row_key_hash": "row_key_hash", "n": "row_key_count", "n_deleted": "row_deleted_count"}


def primary_keys(key_columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Declared primary-key columns in ordinal order, one row per table."""
    on = ["table_catalog", "table_schema", "table_name", "constraint_name"]
    primary = constraints.filter(F.col("constraint_type") == "PRIMARY KEY").select(*on)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name")))
    per_table = key_columns.join(primary, on, "left_semi").groupBy(*on[:3]).agg(ordered.alias("k"))
    return per_table.select(*on[:3], F.transform("k", lambda k: k.column_name).alias("key_columns"))


def retention(props: DataFrame) -> DataFrame:
    """How long deleted files are kept per table: the raw text and the days in it."""
    raw = table_property(props, RETENTION_PROPERTY)
    return raw.select(
        "full_table_name",
        retention_text("value").alias("vacuum_retention_raw"),
        retention_days("value").alias("vacuum_retention_days"),
    )


# ---- targets and dry run ---------------------------------------------------------------------

def row_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in _TARGET]


def _same(columns: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality; Spark still plans it as an equi-join."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def merged_selection(selected: DataFrame) -> DataFrame:
    """Selected rows with their number, one provenance each.

    The same row reached in two ways is selected once: within one provenance, equal rows count as
    often as they were selected; across provenances the larger count holds.
    """
    columns = row_columns(selected)
    per_way = selected.groupBy("request_id", "provenance", *columns).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("matched_on")).alias("matched_on")
    )
    return per_way.groupBy("request_id", *columns).agg(
        F.max("n").alias("n"),
        F.min_by("provenance", _provenance_rank()).alias("provenance"),
        F.array_distinct(F.flatten(F.collect_list("matched_on"))).alias("matched_on"),
    )


def _provenance_rank() -> Column:
    p = F.col("provenance")
    return F.when(p == "direct", 0).when(p == "upstream", 1).otherwise(2)


def dry_run(
    tables: Mapping[str, DataFrame], selected: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Per (request, table): rows selected, rows the targeting would hit, and whether they agree.

    Selecting one of two equal rows of a table without a key disagrees, and rightly so: the other
    would be erased as well.
    """
    parts = []
    for name, chosen in selected.items():
        by = list(keys.get(name) or row_columns(chosen))
        merged = merged_selection(chosen)
        per_item = merged.groupBy("request_id").agg(
            F.sum("n").alias("rows_selected"),
            F.min_by("provenance", _provenance_rank()).alias("provenance"),
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched_on")))), ", ").alias("matched_column_or_tag"),
        )
        targets = merged.select("request_id", *by).distinct()
        table = tables[name].select(*by)
        hits = table.join(targets, _same(by, table, targets)).groupBy("request_id").agg(F.count("*").alias("matched_count"))
        parts.append(
            per_item.join(hits, "request_id", "left").select(
                "request_id",
                F.lit(name).alias("table_full_name"),
                "provenance",
                "matched_column_or_tag",
                "rows_selected",
                F.coalesce("matched_count", F.lit(0)).alias("matched_count"),
                F.lit(BY_KEY if keys.get(name) else BY_ROW).alias("row_targeting_method"),
            )
        )
    checks = reduce(DataFrame.unionByName, parts)
    return checks.withColumn("ok", F.col("rows_selected") == F.col("matched_count"))


def gate(checks: DataFrame) -> DataFrame:
    """Requests of which every table passed: (request_id, all_ok)."""
    return checks.groupBy("request_id").agg(F.bool_and("ok").alias("all_ok"))


def erase(
    table: DataFrame, selected: DataFrame, key: Sequence[str] | None, approved: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split a table into (survivors, erased) by the selected rows of the approved requests."""
    by = list(key or row_columns(selected))
    if approved is not None:
        selected = selected.join(approved, "request_id", "left_semi")
    targets = selected.select(*by).distinct()
    on = _same(by, table, targets)
    return table.join(targets, on, "left_anti"), table.join(targets, on, "left_semi")


# ---- audit trail -----------------------------------------------------------------------------

def row_hashes(selected: Mapping[str, DataFrame], purpose: str = "erasure") -> DataFrame:
    """Salted hashes of the selected rows, long form: (request_id, table_full_name, row_key_hash, n).

    The long form holds any number of rows per item, and equal rows keep their number.
    """
    parts = [
        merged_selection(rows).select(
            "request_id", F.lit(name).alias("table_full_name"),
            hash_row_key(row_text(row_columns(rows)), purpose).alias("row_key_hash"), "n",
        )
        for name, rows in selected.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def erased_by(hashes: DataFrame) -> DataFrame:
    """Add ``n_deleted``: how many of a request's rows its own delete took away.

    Rows that several requests of a run select are deleted once. They are counted for the request with the smallest
    id, so the counts of a table add up to the rows that it lost.
    """
    of_row = ["table_full_name", "row_key_hash"]
    first = hashes.groupBy(*of_row).agg(F.min("request_id").alias("owner"), F.max("n").alias("most"))
    joined = hashes.join(first, of_row)
    return joined.withColumn("n_deleted", F.when(F.col("request_id") == F.col("owner"), F.col("most")).otherwise(F.lit(0))).drop("owner", "most")


def pack_hashes(hashes: DataFrame, per_chunk: int = HASHES_PER_CHUNK) -> DataFrame:
    """Hashes as sorted arrays for storage, in chunks of about ``per_chunk``.

    Small items make one chunk. The chunk follows from the hash, so a very large item is packed by
    many tasks and no array outgrows its task.
    """
    key = ["request_id", "table_full_name"]
    fields = {f: c for f, c in _STORED.items() if f in hashes.columns}
    sizes = hashes.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(per_chunk)).alias("chunks"))
    chunk = F.pmod(F.xxhash64("row_key_hash"), F.col("chunks")).cast("int")
    packed = hashes.join(sizes, key).withColumn("chunk", chunk).groupBy(*key, "chunk").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("h")
    )
    return packed.select(*key, "chunk", *(F.col(f"h.{f}").alias(c) for f, c in fields.items()))


def unpack_hashes(packed: DataFrame) -> DataFrame:
    fields = {f: c for f, c in _STORED.items() if c in packed.columns}
    each = packed.select("request_id", "table_full_name", F.explode(F.arrays_zip(*fields.values())).alias("h"))
    return each.select("request_id", "table_full_name", *(F.col(f"h.{c}").alias(f) for f, c in fields.items()))


def erasure_items(
    checks: DataFrame,
    approved: DataFrame,
    kept: DataFrame,
    executed_at: dt.datetime,
    failures: DataFrame | None = None,
    erased: DataFrame | None = None,
) -> DataFrame:
    """One audit row per (request, table). ``kept`` is :func:`retention`; ``failures(table_full_name, error)`` are
    tables whose delete failed. ``erased`` is :func:`erased_by` of the approved requests: without it, ``rows_deleted``
    is what the dry run matched, and rows that two requests share are counted by both."""
    joined = checks.join(approved, "request_id").join(
        kept.withColumnRenamed("full_table_name", "table_full_name"), "table_full_name", "left"
    )
    if failures is None:
        joined = joined.withColumn("error", F.lit(None).cast("string"))
    else:
        joined = joined.join(failures.select("table_full_name", "error"), "table_full_name", "left")
    if erased is None:
        joined = joined.withColumn("n_deleted", F.col("matched_count"))
    else:
        counted = erased.groupBy("request_id", "table_full_name").agg(F.sum("n_deleted").alias("n_deleted"))
        joined = joined.join(counted, ["request_id", "table_full_name"], "left")
    mismatch = F.format_string("%d rows were selected but %d match in the table.", "rows_selected", "matched_count")
    status = (
        F.when(~F.col("all_ok"), F.lit(ABORTED)).when(F.col("error").isNotNull(), F.lit(FAILED)).otherwise(F.lit(SUCCEEDED))
    )
    message = F.when(~F.col("ok"), mismatch).when(~F.col("all_ok"), F.lit(ABORTED_BY_OTHER)).otherwise(F.col("error"))
    days = F.coalesce("vacuum_retention_days", retention_days(F.lit(None).cast("string")))
    executed = at(executed_at)
    return joined.select(
        "request_id", "table_full_name", "provenance", "matched_column_or_tag",
        "rows_selected",
        F.when(status == SUCCEEDED, F.coalesce("n_deleted", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("rows_deleted"),
        "row_targeting_method",
        F.coalesce("vacuum_retention_raw", retention_text(F.lit(None).cast("string"))).alias("vacuum_retention_raw"),
        days.alias("vacuum_retention_days"),
        (executed + F.make_dt_interval(days)).alias("estimated_purge_by"),
        status.alias("execution_status"),
        message.alias("error_message"),
        executed.alias("executed_at"),
    )


def request_status(items: DataFrame) -> DataFrame:
    """Status of each request from its items: COMPLETED, ABORTED, FAILED or PARTIAL."""
    s = F.col("execution_status")
    status = (
        F.when(F.bool_or(s == ABORTED), F.lit(ABORTED))
        .when(F.bool_and(s == SUCCEEDED), F.lit(COMPLETED))
        .when(F.bool_and(s == FAILED), F.lit(FAILED))
        .otherwise(F.lit(PARTIAL))
    )
    return items.groupBy("request_id").agg(status.alias("status"))


def new_requests(requests: DataFrame, purpose: str, requested_at: dt.datetime) -> DataFrame:
    """Audit rows of new requests ``(request_id, subject_ref, requested_by[, legal_basis])``: the
    subject is stored as a salted hash only."""
    extra = ["legal_basis"] if "legal_basis" in requests.columns else []
    return requests.select(
        "request_id", hash_subject_ref("subject_ref", purpose).alias("subject_ref_hash"), "requested_by", *extra,
        at(requested_at).alias("requested_at"),
        F.lit(PENDING).alias("status"), F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )


def upsert_requests(current: DataFrame, statuses: DataFrame, completed_at: dt.datetime) -> DataFrame:
    """Replace status and completion time of the requests in ``statuses``; the others stay."""
    now = at(completed_at)
    joined = current.join(statuses.withColumnRenamed("status", "new_status"), "request_id", "left")
    done = F.col("new_status").isNotNull()
    return joined.select(
        *[
            F.coalesce("new_status", "status").alias(c) if c == "status"
            else F.when(done, now).otherwise(F.col(c)).alias(c) if c == "completed_at"
            else F.col(c)
            for c in current.columns
        ]
    )


def run_erasure(
    requests: DataFrame,
    tables: Mapping[str, DataFrame],
    selected: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    kept: DataFrame,
    as_of: dt.datetime,
    root: str | None = None,
    write: Callable[[DataFrame, str], None] | None = None,
) -> dict[str, object]:
    """Check everything, erase only for requests of which every table passed, and then record what happened.

    Requests are recorded as PENDING first. Each table's surviving rows are written to a fresh folder below ``root``
    (:func:`publish`), and the write itself counts them. A table whose write fails, or that lost another number of rows
    than the approved requests account for, stays as it was, and its items are FAILED with the error. Only after
    the writes are items, statuses and completion times made, so the evidence never runs ahead of them.

    Returns ``pending``, ``requests``, ``items``, ``hashes`` (of rows that are gone, with ``n_deleted``, the entries that
    :func:`ledger` counts up), ``paths`` of the tables to repoint, ``deleted`` (rows that each table lost),
    and ``survivors``: each table as it stands now. Requests without any selected row are refused. Without ``root`` the
    folders are scratch.
    """
    spark = requests.sparkSession
    checks = materialise(dry_run(tables, selected, keys), "dryrun")
    empty = requests.join(checks, "request_id", "left_anti")
    if not empty.isEmpty():
        raise ValueError("every erasure request needs at least one selected row")
    all_ok = materialise(gate(checks), "gate")
    approved = all_ok.filter("all_ok").select("request_id")
    pending = materialise(new_requests(requests, "erasure", as_of), "pending")
    left = {name: erase(tables[name], rows, keys.get(name), approved)[0] for name, rows in selected.items()}
    hashes = materialise(erased_by(row_hashes(selected).join(approved, "request_id", "left_semi")), "hashes")
    owed = dict(hashes.groupBy("table_full_name").agg(F.sum("n_deleted")).collect())  # one row a table
    paths, errors, written = publish(left, root or scratch_folder(spark, "published"), write)
    deleted = {name: tables[name].count() - rows for name, rows in written.items()}
    for name, lost in deleted.items():
        if lost != owed.get(name, 0):
            errors[name] = f"The table lost {lost} rows, but the requests account for {owed.get(name, 0)}; it was left as it is."
            release(spark, [paths.pop(name)])
    failures = spark.createDataFrame(list(errors.items()), "table_full_name string, error string")
    items = materialise(erasure_items(checks, all_ok, kept, as_of, failures, hashes), "items")
    gone = items.filter(F.col("execution_status") == SUCCEEDED).select("request_id", "table_full_name")
    return {
        "survivors": {name: spark.read.schema(left[name].schema).parquet(paths[name]) if name in paths else tables[name] for name in left},
        "pending": pending,
        "requests": upsert_requests(pending, request_status(items), as_of),
        "items": items,
        "hashes": hashes.join(gone, ["request_id", "table_full_name"], "left_semi"),
        "paths": paths,
        "deleted": {name: lost for name, lost in deleted.items() if name in paths},
    }


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


class Published(NamedTuple):
    paths: dict[str, str]
    errors: dict[str, str]
    #: Rows that each write put down, counted by the write itself.
    written: dict[str, int]


def publish(
    survivors: Mapping[str, DataFrame], root: str, write: Callable[[DataFrame, str], None] | None = None
) -> Published:
    """Write each surviving table to a fresh folder below ``root``: paths to repoint to, errors, and rows written by table.

    ``write(df, path)`` must write the frame that it is given, whole. Overwriting in place by partition would leave a fully erased partition's old rows behind. One table's failure
    does not stop the others; what it wrote is removed. A folder that is not fresh is refused before anything is
    written.
    """
    paths, errors, written = {}, {}, {}
    targets = {name: f"{root}/{name}" for name in survivors}
    for name, df in survivors.items():
        if exists(df.sparkSession, targets[name]):
            raise FileExistsError(targets[name])
    for name, df in survivors.items():
        path, seen = targets[name], Observation()
        try:
            (write or _write)(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
            if not exists(df.sparkSession, path):
                raise FileNotFoundError(path)
            written[name] = seen.get["rows"]
            paths[name] = path
        except Exception as exc:  # noqa: BLE001  whatever it was, the table was not replaced
            errors[name] = str(exc).partition("\n")[0]
            release(df.sparkSession, [path])
    return Published(paths, errors, written)


# ---- restore -----------------------------------------------------------------------------------

def pre_delete_version(items: DataFrame, history: DataFrame) -> DataFrame:
    """For each item the DELETE commit of its table nearest in time to ``executed_at``.

    Returns the item with ``matched_version``, ``pre_delete_version`` (one before) and the gap; items
    of tables without DELETE are left out. Equally near commits: the lower version.

    Items never meet all commits of their table. Both lie on one time line per (table, hour); the
    nearest commit on either side comes from within the hour, or, by hour, from the last hour
    before or the first hour after that has one. A busy table is thus split by hour.
    """
    keys = [c for c in items.columns if c not in ("table_full_name", "executed_at")]
    item = F.struct(*[F.col(k) for k in keys])
    lines = items.select("table_full_name", F.col("executed_at").alias("at"), F.lit(None).cast("bigint").alias("version"), item.alias("item"))
    marks = history.filter(F.col("operation") == "DELETE").select(
        "table_full_name", F.col("commit_time").alias("at"), F.col("version").cast("bigint").alias("version"),
        F.lit(None).cast(lines.schema["item"].dataType).alias("item"),
    )
    both = lines.unionByName(marks).withColumn("hour", F.date_trunc("HOUR", "at"))
    is_commit = F.col("version").isNotNull()
    # Greatest before, least after; of commits at one moment both pick the lower version.
    earlier = F.when(is_commit, F.struct("at", (-F.col("version")).alias("v")))
    later = F.when(is_commit, F.struct("at", F.col("version").alias("v")))

    def running(columns: list[str], order: Column) -> Window:
        return Window.partitionBy(*columns).orderBy(order)

    in_hour = ["table_full_name", "hour"]
    upto = (Window.unboundedPreceding, Window.currentRow)
    local = (
        both.withColumn("b", F.max(earlier).over(running(in_hour, F.asc("at")).rangeBetween(*upto)))
        .withColumn("a", F.min(later).over(running(in_hour, F.desc("at")).rangeBetween(*upto)))
        .filter("item IS NOT NULL")
    )
    hours = both.groupBy(*in_hour).agg(F.max(earlier).alias("last"), F.min(later).alias("first"))
    others = (Window.unboundedPreceding, -1)
    carried = hours.select(
        *in_hour,
        F.last("last", True).over(running(in_hour[:1], F.asc("hour")).rowsBetween(*others)).alias("b_far"),
        F.last("first", True).over(running(in_hour[:1], F.desc("hour")).rowsBetween(*others)).alias("a_far"),
    )
    joined = local.join(carried, in_hour)

    def gap(c: str) -> Column:
        return F.abs(F.timestamp_diff("MICROSECOND", F.col("at"), F.col(f"{c}.at")))

    def option(c: str) -> Column:
        version = F.abs(F.col(f"{c}.v"))
        return F.when(F.col(c).isNotNull(), F.struct(gap(c).alias("gap"), version.alias("version"), F.col(f"{c}.at").alias("at")))

    options = F.array_compact(F.array(*[option(c) for c in ("b", "a", "b_far", "a_far")]))
    best = joined.withColumn("best", F.array_min(options)).filter("best IS NOT NULL")
    return best.select(
        *[F.col(f"item.{k}").alias(k) for k in keys],
        "table_full_name",
        F.col("at").alias("executed_at"),
        F.col("best.version").alias("matched_version"),
        (F.col("best.version") - 1).alias("pre_delete_version"),
        F.col("best.at").alias("matched_timestamp"),
        (F.col("best.gap") / 1e6).alias("time_diff_seconds"),
    )


def restorable_items(items: DataFrame, restorations: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Items that were erased and not yet restored; ``within_window`` tells if files should still exist."""
    done = restorations.filter(F.col("execution_status") == SUCCEEDED).select("request_id", "table_full_name").distinct()
    now = at(as_of, dict(items.dtypes)["estimated_purge_by"])
    return (
        items.filter(F.col("execution_status") == SUCCEEDED)
        .join(done, ["request_id", "table_full_name"], "left_anti")
        .withColumn("within_window", now < F.col("estimated_purge_by"))
    )


def ledger(erased: DataFrame, restored: DataFrame | None = None) -> DataFrame:
    """How many rows of each hash are gone for now: (table_full_name, row_key_hash, outstanding).

    Both inputs are append-only. ``erased`` holds the hashes of succeeded items with ``n_deleted`` (of other evidence,
    ``n``), ``restored(table_full_name, row_key_hash, n)`` what :func:`restore_rows` put back.
    """
    key = ["table_full_name", "row_key_hash"]
    count = "n_deleted" if "n_deleted" in erased.columns else "n"
    entries = erased.select(*key, F.col(count).alias("n"))
    if restored is not None:
        entries = entries.unionByName(restored.select(*key, (-F.col("n")).alias("n")))
    return entries.groupBy(*key).agg(F.sum("n").alias("outstanding")).filter("outstanding > 0")


def restore_rows(
    current: DataFrame, snapshot: DataFrame, hashes: DataFrame, allowed: DataFrame, outstanding: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Put erased rows of one table back from its snapshot: (restored table, outcome per request, entries for the ledger).

    ``hashes`` are the stored row hashes of this table's items, ``allowed`` the requests that may be restored (see
    :func:`restorable_items`), ``outstanding`` the :func:`ledger` of the table's evidence and of all earlier restores;
    without it nothing counts as restored so far. A request is restored only if the snapshot holds exactly as many
    matching rows as were erased, equal rows counted.

    A row that several requests erased is put back once, by the first that asks; for the others it is back already and
    they succeed with fewer rows. ``rows_shared`` tells how many those were.
    """
    columns = snapshot.columns
    outstanding = ledger(hashes) if outstanding is None else outstanding
    wanted = hashes.join(allowed.select("request_id").distinct(), "request_id", "left_semi")
    wanted = wanted.select("request_id", "table_full_name", "row_key_hash", "n")
    rows = snapshot.withColumn("row_key_hash", hash_row_key(row_text(columns), "erasure"))
    found = rows.join(wanted.select("row_key_hash").distinct(), "row_key_hash", "left_semi")
    found = found.groupBy("row_key_hash").agg(F.count("*").alias("found"), F.first(F.struct(*columns)).alias("row"))
    found = materialise(found, "found")
    outcome = (
        wanted.join(found.select("row_key_hash", "found"), "row_key_hash", "left")
        .groupBy("request_id")
        .agg(F.sum("n").alias("expected"), F.sum(F.coalesce("found", F.lit(0))).alias("matched"))
        .withColumn("ok", F.col("expected") == F.col("matched"))
    )
    good = wanted.join(outcome.filter("ok"), "request_id", "left_semi")
    gone = good.join(outstanding.select("table_full_name", "row_key_hash", "outstanding"), ["table_full_name", "row_key_hash"])
    # Requests that share a row draw on what is outstanding one after the other.
    earlier = Window.partitionBy("table_full_name", "row_key_hash").orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    entries = gone.withColumn("n", F.least("n", F.greatest(F.lit(0), F.col("outstanding") - before))).filter("n > 0")
    entries = materialise(entries.select("request_id", "table_full_name", "row_key_hash", "n"), "restored")
    back = entries.groupBy("row_key_hash").agg(F.sum("n").alias("n")).join(found, "row_key_hash")
    restored = back.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
    returned = entries.groupBy("request_id").agg(F.sum("n").alias("returned"))
    lacking = F.format_string("The snapshot holds %d of the %d erased rows, so none was put back.", "matched", "expected")
    outcome = outcome.join(returned, "request_id", "left").select(
        "request_id",
        F.coalesce("returned", F.lit(0)).cast("bigint").alias("rows_restored"),
        F.when(F.col("ok"), F.col("expected") - F.coalesce("returned", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("rows_shared"),
        F.when(F.col("ok"), F.lit(SUCCEEDED)).otherwise(F.lit(FAILED)).alias("execution_status"),
        F.when(~F.col("ok"), lacking).alias("error_message"),
    )
    return current.unionByName(restored), outcome, entries


def restoration_rows(
    outcome: DataFrame, versions: DataFrame, table_full_name: str, restored_by: str, reason: str, restored_at: dt.datetime
) -> DataFrame:
    """Audit rows of attempted restores."""
    of_table = versions.filter(F.col("table_full_name") == table_full_name).select("request_id", "pre_delete_version")
    return outcome.join(of_table, "request_id", "left").select(
        F.sha2(F.concat_ws("|", "request_id", F.lit(table_full_name), F.lit(restored_at.isoformat())), 256).alias("restoration_id"),
        "request_id",
        F.lit(table_full_name).alias("table_full_name"),
        F.lit(restored_by).alias("restored_by"),
        F.lit(reason).alias("restoration_reason"),
        "pre_delete_version",
        F.col("rows_restored").cast("int").alias("rows_restored"),
        "execution_status",
        "error_message",
        at(restored_at).alias("restored_at"),
    )


# ---- listings -----------------------------------------------------------------------------------

def newest_requests(requests: DataFrame) -> DataFrame:
    return requests.orderBy(F.desc("requested_at"), "request_id")


def items_of(items: DataFrame, request_ids: Sequence[str] | None, time_column: str) -> DataFrame:
    """Items or restorations of some requests (or all) in time order."""
    chosen = items if request_ids is None else items.filter(F.col("request_id").isin(*request_ids))
    return chosen.orderBy("request_id", time_column)
