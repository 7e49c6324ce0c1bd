"""Lineage: compact event logs into edges, merge them into a cache, and traverse the cache.

Traversals run level by level for all seeds at once. Each level is one join of a frontier with the
distinct edges; it is written to the shared folder, so a lost executor costs no more than the
current level. What has been visited lies in a few written runs that are merged as they grow, so
neither a plan nor the number of scans of a level grows with the depth. A walk that is still going
after some levels takes strides of 2, 4, 8 .. levels, where the pairs of nodes that far apart are
not many more than the edges.

The edge cache is a folder of hash buckets. A batch rewrites the buckets that it has edges in and
leaves the files of all others as they are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stewardry.functions.durations import at, relative_time
from stewardry.session import exists, materialise, materialise_counted, release

# --- fixed values --------------------------------------------------------------------------
MONITORING_TABLE = r"_(drift|profile)_metrics$"
DEFAULT_ENTITY_TYPE = "unknown"
LOOKBACK_DAYS = 30
UPSTREAM_LABEL, DOWNSTREAM_LABEL = "↑ Upstream", "↓ Downstream"
STATUS_RANK = {"direct": 0, "upstream": 1, "downstream": 2, "traversed": 3}
TRAVERSED_CAPTION = "traversed · no PII match"
# -------------------------------------------------------------------------------------------

TABLE_EDGE = ["source_table_full_name", "target_table_full_name"]
COLUMN_EDGE = ["source_table_full_name", "source_column_name", "target_table_full_name", "target_column_name"]


# ---- compaction and merge ------------------------------------------------------------------

def _window(log: DataFrame, as_of: dt.date, lookback_days: int) -> DataFrame:
    ends = F.col(TABLE_EDGE[0]).isNotNull() & F.col(TABLE_EDGE[1]).isNotNull()
    return log.filter(ends & F.col("event_date").between(F.lit(as_of - dt.timedelta(days=lookback_days)), F.lit(as_of)))


def _without_monitoring(log: DataFrame) -> DataFrame:
    for end in TABLE_EDGE:
        log = log.filter(~F.col(end).rlike(MONITORING_TABLE))
    return log


def compact_table_edges(log: DataFrame, as_of: dt.date, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """One row per (source, target) of the window, with the values of its latest event.

    Events of the same moment are told apart by the value itself, so the result does not depend
    on row order. The log is first reduced to the latest time of each distinct edge and value, by
    hash aggregation ahead of the shuffle; only those few rows are then compared.
    """
    values = ["source_table_catalog", "target_table_catalog", "entity_type"]
    typed = _without_monitoring(_window(log, as_of, lookback_days)).withColumn(
        "entity_type", F.coalesce("entity_type", F.lit(DEFAULT_ENTITY_TYPE))
    )
    seen = typed.groupBy(*TABLE_EDGE, *values).agg(F.max("event_time").alias("event_time"))
    latest = [F.max_by(v, F.struct("event_time", v)).alias(v) for v in values]
    return seen.groupBy(*TABLE_EDGE).agg(*latest, F.max("event_time").alias("last_seen"))


def merge_table_edges(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert a compacted batch: the newer row per edge wins, so batches may come in any order."""
    values = ["source_table_catalog", "target_table_catalog", "entity_type"]
    newest = F.max(F.struct("last_seen", *values)).alias("newest")
    merged = cache.unionByName(batch).groupBy(*TABLE_EDGE).agg(newest)
    return merged.select(*TABLE_EDGE, *[f"newest.{v}" for v in values], "newest.last_seen")


def compact_column_edges(
    log: DataFrame, as_of: dt.date, lookback_days: int = LOOKBACK_DAYS, drop_monitoring: bool = False
) -> DataFrame:
    """One row per column edge of the window. Monitoring tables stay unless asked otherwise."""
    rows = _window(log, as_of, lookback_days)
    if drop_monitoring:
        rows = _without_monitoring(rows)
    return rows.groupBy(*COLUMN_EDGE).agg(F.max("event_time").alias("last_seen"))


def merge_column_edges(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert column edges. Grouping takes NULL column names as equal, so a rerun adds nothing."""
    return cache.unionByName(batch).groupBy(*COLUMN_EDGE).agg(F.max("last_seen").alias("last_seen"))


# ---- the cache as a folder of buckets ---------------------------------------------------------

#: Buckets of a new cache. An existing one keeps the number it was made with.
CACHE_BUCKETS = 64


def _merge(cache: DataFrame, batch: DataFrame) -> DataFrame:
    return merge_column_edges(cache, batch) if "source_column_name" in batch.columns else merge_table_edges(cache, batch)


def _dealt(edges: DataFrame, buckets: int) -> DataFrame:
    keys = COLUMN_EDGE if "source_column_name" in edges.columns else TABLE_EDGE
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    return edges.withColumns({"of": F.lit(buckets), "bucket": bucket}).repartition("bucket")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached edges, one row an edge."""
    return spark.read.parquet(path).drop("of", "bucket")


def refresh_cache(path: str, batch: DataFrame, buckets: int = CACHE_BUCKETS) -> list[int]:
    """Merge compacted table or column edges into the cache at ``path``; returns the buckets that were rewritten.

    Only buckets that hold an edge of the batch are read, merged and replaced, by a dynamic partition overwrite; the
    files of the others are not touched. Merging is idempotent and never takes an edge away, so a batch may be merged
    again after a failure, and no bucket empties. A missing cache is made with ``buckets`` buckets. One refresh may run
    at a time.
    """
    spark = batch.sparkSession
    if not exists(spark, path):
        made = _merge(batch.limit(0), batch)
        _dealt(made, buckets).write.partitionBy("of", "bucket").parquet(path)
        return sorted(r["bucket"] for r in spark.read.parquet(path).select("bucket").distinct().collect())
    cache = spark.read.parquet(path)
    known = cache.select("of").first()
    of = known["of"] if known else buckets
    batch = materialise(_dealt(batch, of), "batch")
    touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # at most ``of`` numbers
    if touched:
        old = cache.filter(F.col("bucket").isin(touched)).drop("of", "bucket")
        merged = _dealt(_merge(old, batch.drop("of", "bucket")), of)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of", "bucket").parquet(path)
        spark.catalog.refreshByPath(path)
    return touched


# ---- traversal ----------------------------------------------------------------------------

def is_table_name(c) -> Column:
    """Exactly three dot-separated parts; events may also point at dashboards or temporary views."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.size(F.split(c, r"\.")) == 3, F.lit(False))


def _reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None, expand: Column | None = None) -> DataFrame:
    """Shortest hop count from each group's seeds to every node they reach, or ``max_depth`` hops of it.

    Nodes are visited once, so the walk ends when a level brings nothing new, cycles or not.

    ``edges(src, dst)`` are already distinct; ``seeds(grp, node)`` count as depth 0. ``expand``
    says which newly reached nodes are followed further; seeds always are.

    With ``hops`` as pairs that a path of exactly ``stride`` edges joins, one join takes the last ``stride`` levels to the
    next ``stride`` levels: a node at depth ``d`` has a node at ``d - stride`` on its shortest path, and paths of that
    length reach nothing sooner than its own depth. So the smallest depth found is the right one.
    """
    first, rows = materialise_counted(seeds.select("grp", "node").distinct().withColumn("depth", F.lit(0)), "seeds")
    visited = VisitedRuns(first, rows)
    frontier, hops, stride, depth, wider = first, edges, 1, 0, True
    while max_depth is None or depth < max_depth:
        while wider and depth >= max(PLAIN_LEVELS, 2 * stride):
            longer = _doubled(hops, MOST_PAIRS * edges.count(), expand)
            wider = longer is not None
            if wider:
                hops, stride = longer, 2 * stride
        if stride > 1:
            frontier = visited.rows().filter(F.col("depth") > depth - stride)
        if expand is not None:
            frontier = frontier.filter(expand | (F.col("depth") == 0))
        hop = frontier.join(hops, F.col("node") == F.col("src")).select("grp", F.col("dst").alias("node"), (F.col("depth") + stride).alias("depth"))
        hop = hop.groupBy("grp", "node").agg(F.min("depth").alias("depth"))
        fresh = hop.join(visited.rows().select("grp", "node"), ["grp", "node"], "left_anti")
        depth += stride
        if max_depth is not None and depth > max_depth:
            fresh = fresh.filter(F.col("depth") <= max_depth)
        frontier, rows = materialise_counted(fresh, "level")
        if not rows:
            break
        visited.add(frontier, rows)
    return visited.rows()


#: Levels that a walk takes one by one before it tries strides.
PLAIN_LEVELS = 8
#: Pairs of nodes that a stride may have for each edge; with more, a walk keeps its stride.
MOST_PAIRS = 4


def _doubled(hops: DataFrame, most: int, expand: Column | None) -> DataFrame | None:
    """Pairs that lie two of ``hops`` apart, or None if making them takes more than ``most`` rows.

    The rows are counted from the degrees of the nodes in the middle, before any pair is made.
    """
    ahead, back = hops.select(F.col("src").alias("node"), F.col("dst").alias("_to")), hops.select(F.col("dst").alias("node"), F.col("src").alias("_from"))
    if expand is not None:
        ahead = ahead.filter(expand)
    through = ahead.groupBy("node").agg(F.count("*").alias("n")).join(back.groupBy("node").agg(F.count("*").alias("m")), "node")
    pairs = through.agg(F.sum(F.col("n") * F.col("m").cast("decimal(20,0)")).alias("pairs")).first()["pairs"]
    if (pairs or 0) > most:
        return None
    return materialise(back.join(ahead, "node").select(F.col("_from").alias("src"), F.col("_to").alias("dst")).distinct(), "hops")


#: Runs of visited nodes that a level may read before small ones are merged.
MOST_RUNS = 6


class VisitedRuns:
    """The visited nodes of a walk: written tables, of which the last ones are merged when there are many.

    A merge takes the last runs together with every run ahead that is at most three times as large as what is merged so
    far. So a row is rewritten only into runs that outgrow its own by a third at least, and large runs stay as they are.
    """

    def __init__(self, first: DataFrame, rows: int) -> None:
        self.runs: list[tuple[DataFrame, int]] = [(first, rows)]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [run for run, _ in self.runs])

    def add(self, level: DataFrame, rows: int) -> None:
        self.runs.append((level, rows))
        if len(self.runs) <= MOST_RUNS:
            return
        start, total = len(self.runs) - 1, rows
        while start and self.runs[start - 1][1] <= 3 * total:
            start -= 1
            total += self.runs[start][1]
        old = self.runs[start:]
        if len(old) > 1:
            merged = materialise(reduce(DataFrame.unionByName, [run for run, _ in old]).coalesce(_tasks(total)), "visited")
            # The newest level is still to be walked on from; the others are no longer read.
            release(level.sparkSession, [run.scratch_path for run, _ in old[:-1]])
            self.runs[start:] = [(merged, total)]


def _tasks(rows: int) -> int:
    """Tasks, and so files, of a merged run: about a million rows each."""
    return 1 + rows // 1_000_000


def trace_tables(
    edges: DataFrame, seeds: DataFrame, direction: str, max_depth: int | None = None, group: str | None = None
) -> DataFrame:
    """Edges around the tables that ``seeds(table_full_name)`` reach upstream or downstream.

    Each edge at a reached table appears once, with the level at which that table was expanded;
    edges back to visited tables are kept, and a table is expanded once, so cycles end. With
    ``group`` (a column of ``seeds``) every group is traced on its own; the walk is then done once
    per distinct seed table and shared by all groups that start there.
    """
    near, far = TABLE_EDGE[::-1] if direction == "up" else TABLE_EDGE
    catalog = "source_table_catalog" if direction == "up" else "target_table_catalog"
    far_alias = "upstream_table" if direction == "up" else "downstream_table"
    catalog_alias = "source_catalog" if direction == "up" else "target_catalog"

    edges = materialise(edges, "edges")
    hops = materialise(edges.select(F.col(near).alias("src"), F.col(far).alias("dst")).distinct(), "hops")
    start = F.col("table_full_name")
    walk = seeds.select((start if group else F.lit(0)).alias("grp"), start.alias("node"))
    reached = _reach(hops, walk, None if max_depth is None else max_depth - 1)
    keys = ["node"]
    if group:
        starts = seeds.select(group, start.alias("grp")).distinct()
        reached = starts.join(reached, "grp").groupBy(group, "node").agg(F.min("depth").alias("depth"))
        keys = [group, "node"]
    found = reached.select(*keys, "depth").join(edges, F.col("node") == F.col(near))
    return found.select(
        *keys[:-1],
        F.col(near).alias("matched_table"),
        F.col(far).alias(far_alias),
        F.col(catalog).alias(catalog_alias),
        "entity_type",
        "last_seen",
        (F.col("depth") + 1).alias("depth"),
    )


def trace_columns_ways(edges: DataFrame, seeds: DataFrame, ways: Mapping[str, str | None], max_depth: int | None = None) -> DataFrame:
    """Columns that ``seeds(subject_id, table_full_name, column_name, tag, value)`` reach, several
    directions in one walk. ``ways`` maps ``up`` or ``down`` to the layer prefix where it stops.

    Every hop is a result, not just the last. A reached column takes the tag and value of its
    nearest seed, the smallest pair if several are equally near. Columns in the stop layer are
    results but lead no further. Ends that are not three-part table names, or that name no column,
    are left out. The walk runs once per distinct seed column, however many subjects share it.
    """
    def node(way: Column, table: Column, column: Column) -> Column:
        return F.struct(way.alias("way"), table.alias("table_full_name"), column.alias("column_name"))

    named = edges.filter(F.col("source_column_name").isNotNull() & F.col("target_column_name").isNotNull())

    def hops_of(way: str) -> DataFrame:
        near, far = ("target", "source") if way == "up" else ("source", "target")
        ends = [node(F.lit(way), F.col(f"{e}_table_full_name"), F.col(f"{e}_column_name")) for e in (near, far)]
        return named.filter(is_table_name(f"{far}_table_full_name")).select(ends[0].alias("src"), ends[1].alias("dst"))

    hops = materialise(reduce(DataFrame.unionByName, [hops_of(w) for w in ways]).distinct(), "edges")
    per_way = F.explode(F.array(*[F.lit(w) for w in ways]))
    starts = seeds.select("subject_id", "table_full_name", "column_name", "tag", "value", per_way.alias("way")).distinct()
    starts = starts.select("subject_id", node(F.col("way"), F.col("table_full_name"), F.col("column_name")).alias("grp"), "tag", "value")
    walk = starts.select("grp", F.col("grp").alias("node")).distinct()
    stopped = F.lit(False)
    for way, prefix in ways.items():
        if prefix is not None:
            stopped = stopped | ((F.col("node.way") == way) & F.col("node.table_full_name").startswith(prefix))
    reached = _reach(hops, walk, max_depth, ~stopped).filter(F.col("depth") > 0)

    nearest = F.min(F.struct("depth", "tag", "value")).alias("nearest")
    per_subject = starts.join(reached, "grp").groupBy("subject_id", "node").agg(nearest)
    own = starts.select("subject_id", F.col("grp").alias("node")).distinct()
    return per_subject.join(own, ["subject_id", "node"], "left_anti").select(
        "subject_id", F.col("node.way").alias("way"), "node.table_full_name", "node.column_name",
        "nearest.tag", "nearest.value", "nearest.depth",
    )


def trace_columns(
    edges: DataFrame,
    seeds: DataFrame,
    direction: str,
    max_depth: int | None = None,
    stop_prefix: str | None = None,
) -> DataFrame:
    """:func:`trace_columns_ways` in one direction."""
    return trace_columns_ways(edges, seeds, {direction: stop_prefix}, max_depth).drop("way")


# ---- summaries over traces -------------------------------------------------------------------

def lineage_summary(up: DataFrame, down: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row per (name, direction): the shortest path, then the latest activity on it."""
    def side(df: DataFrame, table: str, label: str) -> DataFrame:
        return df.select(F.col(table).alias("name"), F.lit(label).alias("direction"), "entity_type", "last_seen", "depth")

    both = side(up, "upstream_table", UPSTREAM_LABEL).unionByName(side(down, "downstream_table", DOWNSTREAM_LABEL))
    now = at(as_of, dict(both.dtypes)["last_seen"])
    age = F.timestamp_diff("MICROSECOND", F.col("last_seen"), now)
    # An unknown time is the least recent: NULL would sort first.
    best = F.min(F.struct("depth", F.col("last_seen").isNull().alias("unknown"), age.alias("age"), "entity_type", "last_seen")).alias("best")
    picked = both.groupBy("name", "direction").agg(best)
    return picked.select(
        "name", "direction", F.col("best.entity_type").alias("entity_type"),
        relative_time("best.last_seen", now).alias("last_activity"), F.col("best.depth").alias("depth"),
    ).orderBy("depth", "direction", "name")


def trace_seeds(matches: DataFrame, conditions: DataFrame) -> DataFrame:
    """Columns to start column lineage from: the searched columns of each matched (subject, table)."""
    matched = matches.select("subject_id", "table_full_name").distinct()
    return conditions.join(matched, ["subject_id", "table_full_name"], "left_semi").select(
        "subject_id", "table_full_name", F.explode("columns").alias("column_name"), "tag", "value"
    )


def lineage_conditions(traced: DataFrame) -> DataFrame:
    """Traced columns as search conditions: per subject, table and tag the columns and the value,
    kept apart by direction where the trace has one."""
    way = ["way"] if "way" in traced.columns else []
    return traced.groupBy("subject_id", *way, "table_full_name", "tag").agg(
        F.sort_array(F.collect_set("column_name")).alias("columns"), F.min("value").alias("value")
    )


def _rank(status: Column) -> Column:
    ladder = F.lit(len(STATUS_RANK))
    for name, rank in STATUS_RANK.items():
        ladder = F.when(status == name, rank).otherwise(ladder)
    return ladder


def lineage_graph(
    copies: DataFrame, conditions: DataFrame, up: DataFrame, down: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each subject's lineage map.

    ``copies(subject_id, table_full_name, provenance, n_rows)`` are tables with the subject's data,
    ``conditions`` the columns searched there, ``up`` and ``down`` the grouped table traces. A table
    that is several things at once takes the first of direct, upstream, downstream, traversed. As
    the map is defined, each found copy is linked to every directly matched table of its subject;
    that join is on distinct tables, never on rows.
    """
    passed = up.select("subject_id", F.col("upstream_table").alias("table_full_name")).unionByName(
        down.select("subject_id", F.col("downstream_table").alias("table_full_name"))
    )
    candidates = copies.select("subject_id", "table_full_name", F.col("provenance").alias("status"), "n_rows").unionByName(
        passed.distinct().select("subject_id", "table_full_name", F.lit("traversed").alias("status"), F.lit(None).cast("bigint").alias("n_rows"))
    )
    best = F.min_by(F.struct("status", "n_rows"), F.struct(_rank(F.col("status")), F.col("n_rows"))).alias("best")
    nodes = candidates.groupBy("subject_id", "table_full_name").agg(best).select(
        "subject_id",
        "table_full_name",
        F.substring_index("table_full_name", ".", 1).alias("catalog"),
        F.col("best.status").alias("status"),
        F.col("best.n_rows").alias("n_rows"),
        F.when(F.col("best.status") == "traversed", F.lit(TRAVERSED_CAPTION))
        .otherwise(F.concat(F.col("best.n_rows").cast("string"), F.lit(" row(s)")))
        .alias("caption"),
    )

    labels = conditions.select("subject_id", "table_full_name", F.explode("columns").alias("column_name"))
    labels = labels.groupBy("subject_id", "table_full_name").agg(
        F.array_join(F.sort_array(F.collect_set("column_name")), ", ").alias("label")
    )
    direct = copies.filter(F.col("provenance") == "direct").select("subject_id", F.col("table_full_name").alias("matched"))
    found = (
        copies.filter(F.col("provenance") != "direct")
        .select("subject_id", "table_full_name", "provenance")
        .join(labels, ["subject_id", "table_full_name"], "left")
        .join(direct.distinct(), "subject_id")
    )
    is_up = F.col("provenance") == "upstream"
    found_edges = found.select(
        "subject_id",
        F.when(is_up, F.col("table_full_name")).otherwise(F.col("matched")).alias("source"),
        F.when(is_up, F.col("matched")).otherwise(F.col("table_full_name")).alias("target"),
        F.col("provenance").alias("status"),
        "label",
    )

    def hop(df: DataFrame, source: str, target: str) -> DataFrame:
        return df.select(
            "subject_id", F.col(source).alias("source"), F.col(target).alias("target"),
            F.lit("traversed").alias("status"), F.lit(None).cast("string").alias("label"),
        )

    every = found_edges.unionByName(hop(up, "upstream_table", "matched_table")).unionByName(
        hop(down, "matched_table", "downstream_table")
    )
    best = F.min_by(F.struct("status", "label"), F.struct(_rank(F.col("status")), F.col("label"))).alias("best")
    edges = every.groupBy("subject_id", "source", "target").agg(best).select(
        "subject_id", "source", "target", F.col("best.status").alias("status"), F.col("best.label").alias("label")
    )
    return nodes, edges
