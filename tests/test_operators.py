"""Properties and deliberate behaviours of the operators, on small tables."""

import datetime as dt
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from stewardry.functions import hashing
from stewardry.functions.fuzzy import weighted_ratio
from stewardry.operators import audit, disclosure as di, erasure as er, lifecycle as lc, lineage as ln, policies as po, reports as rp, search as se, search_index as si
from stewardry.session import materialise
from stewardry.sources.derived import nicknames
from stewardry.streaming.stamping import merge_stamped, read_latest, stamp, stamp_stream

NOW = dt.datetime(2024, 6, 1)
TAG_ROW = "table_catalog string, table_schema string, table_name string, column_name string, tag_name string"


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# ---- policies and lifecycle -------------------------------------------------------------------

def test_conflicting_policies_are_refused(spark):
    tags = spark.createDataFrame([("silver", "s", "t", "c", "class.name"), ("silver", "s", "t", "c", "class.age")], TAG_ROW)
    policies = po.default_policies(spark)
    assert [r.column_name for r in po.policy_conflicts(tags, policies).collect()] == ["c"]
    df = spark.createDataFrame([("x",)], "c string")
    with pytest.raises(po.PolicyConflict):
        po.apply_masks(df, "silver.s.t", tags, policies)
    exempt = po.apply_masks(df, "silver.s.t", tags, policies, ["pii-readers"])
    assert exempt.collect()[0].c == "x"


def test_expiry_splits_without_loss(spark):
    rows = [(i, None if i % 3 == 0 else NOW + dt.timedelta(days=i - 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, _delete_at timestamp")
    kept, expired = lc.expire_rows(df, NOW)
    assert bag(kept) + bag(expired) == bag(df)
    assert all(r._delete_at is not None and r._delete_at <= NOW for r in expired.collect())


def test_sweeping_periods_reads_and_rewrites_one(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, None if i % 7 == 0 else dt.datetime(2024, 1 + i % 9, 1 + i % 28, i % 24)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, _delete_at timestamp")
    lc.write_by_period(df, path)
    files = lambda: {r.p: r.f for r in spark.read.parquet(path).groupBy(F.col("_period").alias("p")).agg(F.collect_set("_metadata.file_path").alias("f")).collect()}
    before, now = files(), dt.datetime(2024, 4, 15, 12)
    assert lc.sweep_periods(spark, path, now) == ["p2024-01", "p2024-02", "p2024-03", "p2024-04"]
    want = Counter(r for r in rows if r[1] is None or r[1] > now)
    assert bag(lc.read_by_period(spark, path)) == want == bag(lc.expire_rows(df, now)[0])
    after = files()
    assert all(after[p] == before[p] for p in after if p != "p2024-04") and set(before) - set(after) == {"p2024-01", "p2024-02", "p2024-03"}
    assert lc.sweep_periods(spark, path, now) == [] and bag(lc.read_by_period(spark, path)) == want
    plan = spark.read.parquet(path).filter("_period = 'p2024-04'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_period" in plan


def _events(spark, rows):
    flat = spark.createDataFrame(rows, "event_date date, action_name string, service_name string, name string, email string, status string")
    return flat.select("event_date", F.lit(None).cast("timestamp").alias("event_time"), "action_name", "service_name", F.create_map(F.lit("full_name_arg"), "name").alias("request_params"),
                       F.struct("email").alias("user_identity"), F.lit("ip").alias("source_ip_address"), F.struct(F.col("status").alias("status_code"), F.lit("e").alias("error_message")).alias("response"))


def test_kpis_from_day_states(spark, tmp_path):
    rnd, day, folder = random.Random(2), dt.date(2024, 3, 20), str(tmp_path / "states")
    kinds = [("generateTemporaryTableCredential", "unityCatalog"), ("login", "accounts"), ("grantPermission", "accounts"), ("other", "x")]
    rows = [(day - dt.timedelta(days=rnd.randrange(45)), *rnd.choice(kinds), rnd.choice(["silver.a.b", "bronze.a.b", "gold.x.y"]), rnd.choice([None, *(f"u{k}" for k in range(12))]), rnd.choice([None, "200", "401"])) for _ in range(600)]
    log = _events(spark, rows)
    for first, last in ((45, 20), (19, 8), (10, 0)):  # the last batch brings some days again
        audit.append_day_states(log.filter(F.col("event_date").between(F.lit(day - dt.timedelta(days=first)), F.lit(day - dt.timedelta(days=last)))), folder)
    for back in (0, 5, 14, 30):
        at = day - dt.timedelta(days=back)
        want = audit.audit_kpis(log, at)
        assert audit.kpis_from_states(spark, folder, at).select(*want.columns).collect() == want.collect()
    plan = audit.audit_kpis(log.write.mode("overwrite").partitionBy("event_date").parquet(f"{folder}-log") or spark.read.parquet(f"{folder}-log"), day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    log = spark.read.parquet(f"{folder}-log")
    for report in (audit.pii_access, audit.pii_access_by_user, audit.pii_access_by_day, audit.failed_auth, audit.permission_changes):
        assert "PartitionFilters: [isnotnull(event_date" in report(log, day)._jdf.queryExecution().executedPlan().toString()


def test_freshness_precedence(spark):
    sc = spark.createDataFrame([("s", "x", n, u, True, True, f"s.x.{n}") for n, u in (("a", False), ("b", True), ("c", True), ("d", True), ("e", True), ("f", True))],
                               "table_catalog string, table_schema string, table_name string, has_updated_at boolean, has_inserted_at boolean, has_delete_at boolean, full_table_name string")
    edge = NOW - dt.timedelta(minutes=60, seconds=59)
    metrics = spark.createDataFrame([("s.x.a", None, None, 1440, "e"), ("s.x.b", None, None, 1440, "e"), ("s.x.c", None, "1h", 60, None), ("s.x.d", edge, "1h", 60, None), ("s.x.e", NOW - dt.timedelta(minutes=61), "1h", 60, None)],
                                    "full_table_name string, max_updated_at timestamp, freshness_sla string, freshness_sla_minutes int, error string")
    got = {r.table_name: r.sla_status for r in lc.retention_compliance(sc, metrics, NOW).collect()}
    assert got == {"a": "NO_COLUMN", "b": "ERROR", "c": "NEVER_UPDATED", "d": "FRESH", "e": "STALE", "f": "NEVER_UPDATED"}


# ---- lineage ----------------------------------------------------------------------------------

def _edges(spark, pairs):
    rows = [(a, b, "c", "c", "JOB", NOW) for a, b in pairs]
    return spark.createDataFrame(rows, "source_table_full_name string, target_table_full_name string, source_table_catalog string, target_table_catalog string, entity_type string, last_seen timestamp")


def test_merge_is_idempotent_and_any_split_equals_the_whole(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice(["x", None]), rnd.choice("ab"), rnd.choice(["y", None]), NOW - dt.timedelta(days=rnd.randrange(20)), None) for _ in range(60)]
    log = spark.createDataFrame(rows, "source_table_full_name string, source_column_name string, target_table_full_name string, target_column_name string, event_time timestamp, event_date date")
    log = log.withColumn("event_date", F.to_date("event_time"))
    day = NOW.date()
    whole = ln.compact_column_edges(log, day, 100)
    assert bag(ln.merge_column_edges(whole, whole)) == bag(whole)
    early, late = log.filter("event_date < date'2024-05-20'"), log.filter("event_date >= date'2024-05-20'")
    parts = [ln.compact_column_edges(p, day, 100) for p in (late, early)]
    assert bag(ln.merge_column_edges(*parts)) == bag(whole)


@pytest.mark.parametrize("seed", [1, 2])
def test_table_trace_equals_breadth_first_search(spark, seed):
    rnd = random.Random(seed)
    names = [f"c.s.t{i}" for i in range(12)]
    pairs = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(22)})
    groups = {"g1": names[:2], "g2": names[5:6]}
    want = set()
    for group, starts in groups.items():
        depth, queue = {n: 0 for n in starts}, deque(starts)
        while queue:
            node = queue.popleft()
            for a, b in pairs:
                if a == node:
                    want.add((group, a, b, depth[node] + 1))
                    if b not in depth:
                        depth[b] = depth[node] + 1
                        queue.append(b)
    seeds = spark.createDataFrame([(g, n) for g, ns in groups.items() for n in ns], "subject_id string, table_full_name string")
    got = ln.trace_tables(_edges(spark, pairs), seeds, "down", group="subject_id").collect()
    assert {(r.subject_id, r.matched_table, r.downstream_table, r.depth) for r in got} == want and len(got) == len(want)
    one = ln.trace_tables(_edges(spark, pairs), seeds.filter("subject_id = 'g1'"), "down").collect()
    assert {(r.matched_table, r.downstream_table, r.depth) for r in one} == {w[1:] for w in want if w[0] == "g1"}


def test_a_deep_walk_takes_strides(spark, monkeypatch):
    """Chains with side ways, shortcuts, a ring, and nodes that lead no further, against breadth-first search."""
    pairs = {(f"a{i}", f"a{i + 1}") for i in range(60)} | {(f"b{i}", f"b{(i + 1) % 25}") for i in range(25)}
    pairs |= {("a5", "a9"), ("a30", "x"), ("x", "a34"), ("b3", "a40"), ("a50", "stop1"), ("stop1", "y"), ("stop0", "z")}
    seeds = [("g", "a0"), ("h", "b7"), ("h", "stop0"), ("i", "a58")]
    edges = materialise(spark.createDataFrame(sorted(pairs), "src string, dst string"), "edges")
    jobs, write = [], ln.materialise_counted
    monkeypatch.setattr(ln, "materialise_counted", lambda df, label: jobs.append(label) or write(df, label))
    for most in (None, 29):
        want = {}
        for group, seed in seeds:
            queue = deque([(seed, 0)])
            while queue:
                node, depth = queue.popleft()
                if want.get((group, node), depth + 1) <= depth:
                    continue
                want[group, node] = depth
                if (depth == 0 or not node.startswith("stop")) and (most is None or depth < most):
                    queue.extend((b, depth + 1) for a, b in pairs if a == node)
        got = ln._reach(edges, spark.createDataFrame(seeds, "grp string, node string"), most, ~F.col("node").startswith("stop")).collect()
        assert {(r.grp, r.node): r.depth for r in got} == want and len(got) == len(want)
    assert jobs.count("level") <= 25  # 61 and 29 levels


def test_visited_runs_stay_few_and_whole(spark):
    """However long the walk, a level reads few runs, and they hold every visited node once."""
    rnd = random.Random(4)
    frame = lambda k, n: materialise(spark.range(k, k + n).toDF("node"), "run")
    visited, total, most, rewritten, seen = ln.VisitedRuns(frame(0, 1), 1), 1, 0, 0, 1
    for step in range(60):
        n = 1 if step % 9 else rnd.choice([1, 40, 400])
        before = {id(run) for run, _ in visited.runs}
        visited.add(frame(total, n), n)
        total, most = total + n, max(most, len(visited.runs))
        rewritten += sum(rows for run, rows in visited.runs if id(run) not in before) - n
        seen += n
    assert most <= ln.MOST_RUNS + 1 and rewritten < 8 * seen
    assert sorted(r.node for r in visited.rows().collect()) == list(range(total))


def test_the_cache_is_merged_in_place(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "source_table_full_name string, source_column_name string, target_table_full_name string, target_column_name string, last_seen timestamp"
    edges = lambda rows: spark.createDataFrame([(f"c.s.t{a}", x, f"c.s.t{b}", "y", NOW + dt.timedelta(days=day)) for a, x, b, day in rows], schema)
    first = [(k, "x", k + 1, 0) for k in range(40)] + [(1, None, 2, 0)]
    assert ln.refresh_cache(path, edges(first), buckets=16)
    files = lambda: {r.bucket: r.f for r in spark.read.parquet(path).groupBy("bucket").agg(F.collect_set("_metadata.file_path").alias("f")).collect()}
    before = files()
    batch = [(3, "x", 4, 9), (1, None, 2, 5), (5, "x", 6, -3), (90, "x", 91, 1)]
    for _ in range(2):  # a batch merged again changes nothing
        touched = ln.refresh_cache(path, edges(batch), buckets=5)
        want = ln.merge_column_edges(edges(first), edges(batch))
        assert bag(ln.read_cache(spark, path)) == bag(want) and 0 < len(touched) <= 4
    assert {b: f for b, f in files().items() if b not in touched} == {b: f for b, f in before.items() if b not in touched}
    assert ln.refresh_cache(path, edges([])) == [] and bag(ln.read_cache(spark, path)) == bag(want)


def test_walks_have_no_depth_cap(spark):
    names = [f"c.s.t{i}" for i in range(31)]
    pairs = list(zip(names, names[1:]))
    seeds = spark.createDataFrame([("g", names[0])], "subject_id string, table_full_name string")
    assert ln.trace_tables(_edges(spark, pairs), seeds, "down").agg(F.max("depth")).first()[0] == 30
    assert ln.trace_tables(_edges(spark, pairs), seeds, "down", max_depth=3).agg(F.max("depth")).first()[0] == 3
    rows = [(a, "x", b, "x") for a, b in pairs]
    edges = spark.createDataFrame(rows, "source_table_full_name string, source_column_name string, target_table_full_name string, target_column_name string")
    starts = spark.createDataFrame([("s", names[0], "x", "class.name", "ann")], "subject_id string, table_full_name string, column_name string, tag string, value string")
    assert ln.trace_columns(edges, starts, "down").count() == 30


def test_reports_and_windows_end_on_the_report_day(spark):
    log = spark.createDataFrame([("a", "b", dt.datetime(2024, 5, 30)), ("a", "b", dt.datetime(2025, 1, 1))], "source_table_full_name string, target_table_full_name string, event_time timestamp")
    log = log.selectExpr("*", "'x' AS source_column_name", "'y' AS target_column_name", "to_date(event_time) AS event_date")
    assert ln.compact_column_edges(log, NOW.date()).first().last_seen == dt.datetime(2024, 5, 30)
    event = ("accounts", "tokenLogin", {"full_name_arg": "gold.a.b", "securable_type": "TABLE"}, ("u@x",), "ip", ("401", "no"))
    days = [dt.date(2024, 5, 31), dt.date(2024, 6, 2)]
    audit_log = spark.createDataFrame([(dt.datetime(d.year, d.month, d.day), d, *event) for d in days], "event_time timestamp, event_date date, service_name string, action_name string, request_params map<string,string>, user_identity struct<email: string>, source_ip_address string, response struct<status_code: string, error_message: string>")
    assert audit.audit_kpis(audit_log, NOW.date()).first().failed_auth_7d == 1
    assert [r.event_time.date() for r in audit.failed_auth(audit_log, NOW.date()).collect()] == days[:1]


def test_unknown_activity_is_the_least_recent(spark):
    schema = "upstream_table string, entity_type string, last_seen timestamp, depth int"
    up = spark.createDataFrame([("t", "JOB", None, 1), ("t", "JOB", NOW - dt.timedelta(days=2), 1)], schema)
    down = spark.createDataFrame([], schema.replace("upstream", "downstream"))
    assert [r.last_activity for r in ln.lineage_summary(up, down, NOW).collect()] == ["2 days ago"]


def test_nicknames_fold_like_rows(spark):
    pairs = spark.createDataFrame([("Zoë", "Zoey")], "nickname string, canonical string")
    subjects = spark.createDataFrame([("s", "class.name", "Zoey Hill")], "subject_id string, tag string, value string")
    variants = {r.variant for r in se.expand_tokens(subjects, pairs).collect()}
    assert variants == {"zoey", "zoe", "hill"}


def test_matches_are_not_capped(spark):
    rows = [("s", "a.b.c", f"r{i}", 1, float(i)) for i in range(700)]
    found = spark.createDataFrame(rows, "subject_id string, table_full_name string, row_id string, n_rows bigint, score double")
    assert {(r.n_found, r.n) for r in se.top_matches(found).groupBy("n_found").agg(F.count("*").alias("n")).collect()} == {(700, 700)}
    best = se.top_matches(found, 3).collect()
    assert {r.row_id for r in best} == {"r699", "r698", "r697"} and all(r.capped and r.n_found == 700 for r in best)


def test_column_trace_stops_at_bronze_and_skips_other_ends(spark):
    rows = [("bronze.a.b", "x", "silver.a.b", "x"), ("bronze.z.z", "x", "bronze.a.b", "x"), ("dashboard", "q", "silver.a.b", "x"), ("silver.a.b", None, "gold.a.b", "y"), ("silver.a.b", "x", "gold.a.b", "x")]
    edges = spark.createDataFrame(rows, "source_table_full_name string, source_column_name string, target_table_full_name string, target_column_name string")
    seeds = spark.createDataFrame([("s1", "gold.a.b", "x", "class.name", "ann"), ("s2", "silver.a.b", "x", "class.name", "bob")], "subject_id string, table_full_name string, column_name string, tag string, value string")
    got = {(r.subject_id, r.table_full_name, r.value, r.depth) for r in ln.trace_columns(edges, seeds, "up", stop_prefix="bronze.").collect()}
    assert got == {("s1", "silver.a.b", "ann", 1), ("s1", "bronze.a.b", "ann", 2), ("s2", "bronze.a.b", "bob", 1)}


# ---- search -----------------------------------------------------------------------------------

def _search(spark, people, subjects, columns="first string, last string, mail string, phone string, place string", tags=None, **options):
    table = spark.createDataFrame(people, columns)
    tags = tags or {"first": "class.name", "last": "class.name", "mail": "class.email_address", "phone": "class.phone_number", "place": "class.location"}
    tag_rows = spark.createDataFrame([("silver", "s", "t", c, t) for c, t in tags.items()], TAG_ROW)
    wanted = spark.createDataFrame(subjects, "subject_id string, tag string, value string")
    ids = {r.k: r.i for r in table.withColumn("k", se.row_id(table, None)).select("k", table.columns[0]).toDF("k", "i").collect()}
    found = se.search_tables(wanted, {"silver.s.t": table}, tag_rows, nicknames(spark), **options).collect()
    return found, ids


PEOPLE = [
    ("Anthony", "Hill", "TH@x.org", "+44 7911 123456", "1 Road, N1 9PF"),
    ("Joanne", "Hilliard", None, "07911123456", "London"),
    ("José", "García", "jg@x.org", None, "sw1a1aa"),
    ("Tony", "Hill", "th2@x.org", "1", "50%"),
    (None, "Hill", "a_b@x.org", "", None),
]


@pytest.mark.parametrize("wanted,expected", [
    ([("class.name", "Mr. Tony Hill")], {"Anthony", "Tony"}),
    ([("class.name", "ann hill")], {"Joanne"}),
    ([("class.name", "o")], {"Anthony", "Joanne", "José", "Tony"}),
    ([("class.name", "JOSE garcia")], {"José"}),
    ([("class.email_address", "th@X.ORG")], {"Anthony"}),
    ([("class.phone_number", "0044 7911 123456")], {"Anthony", "Joanne"}),
    ([("class.phone_number", "n/a")], set()),
    ([("class.location", "n1 9pf")], {"Anthony"}),
    ([("class.location", "SW1A 1AA")], {"José"}),
    ([("class.location", "LOND")], {"Joanne"}),
    ([("class.location", "%")], {"Tony"}),
    ([("class.name", "hill"), ("class.phone_number", "7911123456")], {"Anthony", "Joanne"}),
    ([("class.name", "hill"), ("class.email_address", "jg@x.org")], set()),
    ([("class.passport", "123")], set()),
])
def test_search_rules(spark, wanted, expected):
    found, ids = _search(spark, PEOPLE, [("s", t, v) for t, v in wanted], threshold=None)
    assert {ids[r.row_id] for r in found} == expected and len(found) == len(expected)


def test_unfolded_columns_do_not_match_accents(spark):
    assert _search(spark, PEOPLE, [("s", "class.name", "jose")], fold_columns=False, threshold=None)[0] == []


def test_many_subjects_equal_single_searches(spark):
    rnd = random.Random(3)
    people = [("".join(rnd.choices("abc", k=rnd.randrange(2, 9))), "".join(rnd.choices("abc", k=4)), f"m{i % 7}@x", str(i % 5) * 9, "x") for i in range(120)]
    subjects = [(f"s{i}", "class.name", "".join(rnd.choices("abc", k=rnd.randrange(1, 7)))) for i in range(70)]
    subjects += [(f"s{i}", "class.email_address", f"M{i % 9}@X") for i in range(0, 40, 2)] + [(f"t{i}", "class.phone_number", str(i) * 9) for i in range(3)]
    rows = lambda found: {(r.subject_id, r.row_id, r.n_rows) for r in found}
    together = rows(_search(spark, people, subjects, threshold=None)[0])
    want = set()
    table = spark.createDataFrame(people, "first string, last string, mail string, phone string, place string")
    keyed = [(r, r.k) for r in table.withColumn("k", se.row_id(table, None)).collect()]
    counts = Counter(k for _, k in keyed)
    for sid in {s for s, _, _ in subjects}:
        asks = {t: v for s, t, v in subjects if s == sid}
        for r, k in keyed:
            hit = {"class.name": asks.get("class.name", "") in f"{r.first} {r.last}", "class.email_address": r.mail.lower() == asks.get("class.email_address", "").lower(), "class.phone_number": r.phone == asks.get("class.phone_number")}
            if all(hit[t] for t in asks):
                want.add((sid, k, counts[k]))
    assert together == want


def test_equal_rows_are_counted_and_weak_names_dropped(spark):
    people = [PEOPLE[0]] * 3 + [PEOPLE[1]]
    found, ids = _search(spark, people, [("s", "class.name", "hill")])
    assert {(ids[r.row_id], r.n_rows) for r in found} == {("Anthony", 3), ("Joanne", 1)}
    strict, _ = _search(spark, people, [("s", "class.name", "ann hill")], threshold=99)
    assert strict == []


def test_equal_texts_are_compared_once(spark, monkeypatch):
    """Rows with equal texts offer keys, are compared and are scored as one; each row is still found and counted."""
    people = spark.createDataFrame([(i % 50, ("Anna", "Joanne", "Bob")[i % 3], "Hill") for i in range(300)], "booking int, first string, last string")
    tags = spark.createDataFrame([("silver", "s", "t", c, "class.name") for c in ("first", "last")], TAG_ROW)
    subjects = spark.createDataFrame([("a", "class.name", "ann hill"), ("a", "class.name", "hill"), ("b", "class.name", "bob hill")], "subject_id string, tag string, value string")
    written, write = {}, se.materialise
    monkeypatch.setattr(se, "materialise", lambda df, label="step": written.setdefault(label, write(df, label)))
    found = se.search_tables(subjects, {"silver.s.t": people}, tags, nicknames(spark), threshold=None, primary_keys={"silver.s.t": ["booking"]}).collect()
    assert written["texts"].count() == 3 and written["hits"].count() == 3
    # Rows that share a key and differ in their names are told apart by their number or lie together at the weakest score.
    ids = {r.k: r.booking for r in people.select("booking", se.row_id(people, ["booking"]).alias("k")).distinct().collect()}
    want = {}
    for booking in range(50):
        for subject, names, asked in (("a", ("Anna", "Joanne"), ("ann hill", "hill")), ("b", ("Bob",), ("bob hill",))):
            counts = Counter(first for i in range(300) if i % 50 == booking for first in [("Anna", "Joanne", "Bob")[i % 3]] if first in names)
            for first, n in counts.items():
                score = min(weighted_ratio(a, f"{first} Hill".lower()) for a in asked)
                want[subject, booking, n] = min(score, want.get((subject, booking, n), 100.0))
    assert {(r.subject_id, ids[r.row_id], r.n_rows): r.score for r in found} == want and len(found) == len(want)


def test_dates_match_timestamp_columns(spark):
    people = [("a", dt.datetime(1985, 7, 23))]
    found, _ = _search(spark, people, [("s", "class.date_of_birth", "1985-07-23")], columns="i string, born timestamp", tags={"born": "class.date_of_birth"})
    assert len(found) == 1


def test_the_index_finds_what_the_search_finds(spark, tmp_path):
    tags = {"first": "class.name", "last": "class.name", "mail": "class.email_address", "phone": "class.phone_number", "place": "class.location"}
    columns = "first string, last string, mail string, phone string, place string"
    rows = spark.createDataFrame([("silver", "s", "t", c, t) for c, t in tags.items()], TAG_ROW)
    rnd = random.Random(8)
    people = [("".join(rnd.choices("abc", k=rnd.randrange(1, 9))), "".join(rnd.choices("abc", k=4)), f"m{i % 9}@x", str(i % 6) * 9, f"{i} High St AB1 {i % 9}CD") for i in range(60)]
    asked = [(f"n{i}", "class.name", "".join(rnd.choices("abc", k=rnd.randrange(1, 7)))) for i in range(25)] + [("m", "class.email_address", "M3@X")]
    asked += [("p", "class.phone_number", "333333333"), ("p", "class.location", "ab1 4cd"), ("q", "class.location", "7 high")]
    subjects = spark.createDataFrame(asked, "subject_id string, tag string, value string")
    folder = str(tmp_path / "t")
    write = lambda part, to=folder: spark.createDataFrame(part, columns).repartition(2).write.mode("append").parquet(to)
    index = si.SearchIndex("test_index", str(tmp_path / "index"), buckets=8)

    def both(where=folder):
        tables = {"silver.s.t": spark.read.parquet(where)}
        done = si.refresh(index, tables, rows)
        want = se.search_tables(subjects, tables, rows, nicknames(spark))
        got = si.search_index(index, subjects, tables, rows, nicknames(spark))
        assert bag(got) == bag(want.select(*got.columns)) and want.count() > 10
        return done

    write(people[:30])
    assert both() == {"added": 2, "gone": 0}
    assert both() == {"added": 0, "gone": 0}
    write(people[20:])  # equal rows in other files
    assert both() == {"added": 2, "gone": 0}
    other = str(tmp_path / "fresh")
    write(people[5:40], other)
    assert both(other) == {"added": 2, "gone": 4}

    one = subjects.filter("subject_id = 'm'")
    hashed = se.question_keys(se.questions(se.direct_requests(se.normalise_subjects(one), se.direct_scopes(rows, {"silver.s.t": None})), nicknames(spark))[1])
    wide = si._postings_of(index, materialise(hashed, "keys"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else plans do not name buckets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SelectedBucketsCount: 1 out of 8" in wide.select("*")._jdf.queryExecution().executedPlan().toString()
        pairs = materialise(wide.select("row", "spec_id").distinct(), "pairs")
        joined = spark.table(index.rows).join(pairs, "row")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SortMergeJoin" in joined and joined.count("Exchange hashpartitioning") == 1
    si.drop(index, spark)


def test_equal_texts_are_indexed_once(spark, tmp_path):
    """Keys are made and kept per distinct text, in however many rows and files it is; a search still finds each row."""
    tags = spark.createDataFrame([("silver", "s", "t", "name", "class.name")], TAG_ROW)
    subjects = spark.createDataFrame([("a", "class.name", "anna hill"), ("b", "class.name", "hill"), ("c", "class.name", "nobody")], "subject_id string, tag string, value string")
    index = si.SearchIndex("texts_index", str(tmp_path / "index"), buckets=4)
    sizes = []
    for part in range(3):
        spark.createDataFrame([(100 * part + i % 40, ("Anna Hill", "Bob Hill")[i % 2]) for i in range(50)], "booking int, name string").write.mode("append").parquet(str(tmp_path / "t"))
        tables = {"silver.s.t": spark.read.parquet(str(tmp_path / "t"))}
        si.refresh(index, tables, tags)
        sizes.append((spark.table(index.postings).count(), spark.table(index.rows).count()))
        got = si.search_index(index, subjects, tables, tags, nicknames(spark), threshold=None)
        assert bag(got) == bag(se.search_tables(subjects, tables, tags, nicknames(spark), threshold=None).select(*got.columns))
        assert {r["subject_id"]: r["n"] for r in got.groupBy("subject_id").agg(F.sum("n_rows").alias("n")).collect()} == {"a": 25 * (part + 1), "b": 50 * (part + 1)}
    pieces = sum(len({name[i:i + n] for i in range(len(name) - n + 1)}) for name in ("anna hill", "bob hill") for n in se.PIECES)
    assert sizes == [(pieces, 2)] * 3
    si.drop(index, spark)


# ---- erasure and restore -------------------------------------------------------------------------

COLUMNS = "k int, v string, w double"
ROWS = [(1, "a", 1.0), (1, "a", 1.0), (2, None, 2.0), (3, "c", None), (4, "d", 4.0)]
KEPT = "full_table_name string, vacuum_retention_raw string, vacuum_retention_days int"


def _chosen(spark, rows):
    return spark.createDataFrame(rows, "request_id string, provenance string, matched_on string, " + COLUMNS)


def _run(spark, selected, keys=None, requests=("r",)):
    tables = {"silver.s.t": spark.createDataFrame(ROWS, COLUMNS), "silver.s.u": spark.createDataFrame(ROWS[2:], COLUMNS)}
    asked = spark.createDataFrame([(r, "x", "me", "law") for r in requests], "request_id string, subject_ref string, requested_by string, legal_basis string")
    kept = spark.createDataFrame([], KEPT)
    return tables, er.run_erasure(asked, tables, {n: _chosen(spark, rows) for n, rows in selected.items()}, keys or {}, kept, NOW)


def test_one_failed_table_keeps_every_row(spark):
    tables, run = _run(spark, {"silver.s.t": [("r", "direct", "x", *ROWS[0])], "silver.s.u": [("r", "direct", "x", *ROWS[2])]})
    for name, survivors in run["survivors"].items():
        assert bag(survivors) == bag(tables[name])
    items = {i.table_full_name: i for i in run["items"].collect()}
    assert {i.execution_status for i in items.values()} == {"ABORTED"} and {i.rows_deleted for i in items.values()} == {0}
    assert "were selected but" in items["silver.s.t"].error_message and "Another table" in items["silver.s.u"].error_message
    assert run["requests"].collect()[0].status == "ABORTED" and run["hashes"].count() == 0


def test_erase_then_restore_gives_the_table_back(spark):
    chosen = [("r", "direct", "x", *ROWS[0]), ("r", "direct", "x", *ROWS[1]), ("r", "direct", "x", *ROWS[2]), ("r", "upstream", "y", *ROWS[2])]
    tables, run = _run(spark, {"silver.s.t": chosen})
    left = run["survivors"]["silver.s.t"]
    assert bag(left) == Counter(ROWS[3:])
    item = run["items"].collect()[0]
    assert (item.rows_selected, item.rows_deleted, item.provenance, item.vacuum_retention_days) == (3, 3, "direct", 7)
    packed = er.pack_hashes(run["hashes"], per_chunk=1)
    assert bag(er.unpack_hashes(packed)) == bag(run["hashes"].select("request_id", "table_full_name", "row_key_hash", "n", "n_deleted"))
    never = spark.createDataFrame([], "request_id string, table_full_name string, execution_status string")
    allowed = er.restorable_items(run["items"], never, NOW)
    table, outcome, _ = er.restore_rows(left, tables["silver.s.t"], er.unpack_hashes(packed), allowed)
    assert bag(table) == Counter(ROWS) and outcome.collect()[0].rows_restored == 3
    short = spark.createDataFrame(ROWS[1:], COLUMNS)
    table, outcome, _ = er.restore_rows(left, short, run["hashes"], allowed)
    assert bag(table) == bag(left) and outcome.collect()[0].execution_status == "FAILED"
    done = spark.createDataFrame([("r", "silver.s.t", "SUCCEEDED")], "request_id string, table_full_name string, execution_status string")
    table, *_ = er.restore_rows(left, tables["silver.s.t"], run["hashes"], er.restorable_items(run["items"], done, NOW))
    assert bag(table) == bag(left)


def _shared(spark):
    """Requests a and b both erase both copies of row 1 and row 2; b alone erases row 3."""
    both = [("direct", "x", *ROWS[0]), ("direct", "x", *ROWS[1]), ("direct", "x", *ROWS[2])]
    chosen = [("a", *r) for r in both] + [("b", *r) for r in both] + [("b", "direct", "x", *ROWS[3])]
    return _run(spark, {"silver.s.t": chosen}, requests=("a", "b"))


def test_shared_rows_are_counted_once_and_come_back_once(spark):
    tables, run = _shared(spark)
    items = {i.request_id: i for i in run["items"].collect()}
    assert {r: (i.rows_selected, i.rows_deleted) for r, i in items.items()} == {"a": (3, 3), "b": (4, 1)}
    assert run["deleted"] == {"silver.s.t": 4}
    left, snapshot = run["survivors"]["silver.s.t"], tables["silver.s.t"]
    hashes = er.unpack_hashes(er.pack_hashes(run["hashes"], per_chunk=2))
    one = lambda r: run["items"].filter(F.col("request_id") == r)
    for order in (("a", "b"), ("b", "a")):
        table, done = left, None
        for r in order:
            table, outcome, entries = er.restore_rows(table, snapshot, hashes, one(r), er.ledger(hashes, done))
            done = entries if done is None else done.unionByName(entries)
            got = outcome.collect()[0]
            assert got.execution_status == "SUCCEEDED" and got.rows_restored + got.rows_shared == items[r].rows_selected
        assert bag(table) == Counter(ROWS) and er.ledger(hashes, done).isEmpty()
    table, outcome, _ = er.restore_rows(left, snapshot, hashes, run["items"])
    assert bag(table) == Counter(ROWS) and sum(o.rows_restored for o in outcome.collect()) == 4
    table, *_ = er.restore_rows(left, snapshot, hashes, one("a"))
    assert bag(table) == Counter(ROWS[:3] + ROWS[4:])


def test_rows_erased_twice_in_turn_come_back_twice(spark):
    """The same row, erased, written again and erased by a second request, is two rows in the ledger."""
    table = spark.createDataFrame(ROWS[:1], COLUMNS)
    hashes = er.row_hashes({"silver.s.t": _chosen(spark, [("a", "direct", "x", *ROWS[0]), ("b", "direct", "x", *ROWS[0])])}).withColumn("n_deleted", F.lit(1))
    asked = hashes.select("request_id").distinct()
    back, outcome, _ = er.restore_rows(table.limit(0), table, hashes, asked)
    assert bag(back) == Counter(ROWS[:1] * 2) and {o.rows_restored for o in outcome.collect()} == {1}


def test_a_delete_that_took_other_rows_fails_and_leaves_the_table(spark):
    tables = {"silver.s.t": spark.createDataFrame(ROWS, COLUMNS)}
    asked = spark.createDataFrame([("r", "x", "me", "law")], "request_id string, subject_ref string, requested_by string, legal_basis string")
    chosen = {"silver.s.t": _chosen(spark, [("r", "direct", "x", *ROWS[3])])}
    kept = spark.createDataFrame([], KEPT)
    # The table changes between dry run and delete: a reader that shows one more row of the selected kind.
    grown = {"silver.s.t": tables["silver.s.t"].unionByName(spark.createDataFrame([ROWS[3]], COLUMNS))}
    real, calls = er.dry_run, []
    try:
        er.dry_run = lambda t, *rest: calls.append(1) or real(tables, *rest)
        run = er.run_erasure(asked, grown, chosen, {}, kept, NOW)
    finally:
        er.dry_run = real
    item = run["items"].collect()[0]
    assert calls and (item.execution_status, item.rows_deleted) == ("FAILED", 0) and "lost 2 rows" in item.error_message
    assert bag(run["survivors"]["silver.s.t"]) == Counter(ROWS + [ROWS[3]]) and not run["paths"] and run["hashes"].isEmpty()
    paths, errors, _ = er.publish(tables, str(run["pending"].scratch_path) + "-nothing", lambda df, path: None)
    assert not paths and "silver.s.t" in errors


def test_erasing_by_key_is_null_safe_and_refuses_empty_requests(spark):
    _, run = _run(spark, {"silver.s.u": [("r", "direct", "x", *ROWS[2])]}, {"silver.s.u": ["k"]})
    assert bag(run["survivors"]["silver.s.u"]) == Counter(ROWS[3:]) and run["items"].collect()[0].row_targeting_method == "primary_key"
    with pytest.raises(ValueError):
        _run(spark, {"silver.s.u": [("r", "direct", "x", *ROWS[2])]}, requests=("r", "nothing"))


def test_publish_writes_a_fresh_folder(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLUMNS)
    paths, errors, written = er.publish({"silver.s.t": df}, str(tmp_path / "v1"))
    assert not errors and written == {"silver.s.t": len(ROWS)}
    assert bag(spark.read.parquet(paths["silver.s.t"])) == Counter(ROWS)
    with pytest.raises(Exception):
        er.publish({"silver.s.t": df}, str(tmp_path / "v1"))


def test_nearest_delete_across_hours(spark):
    rnd = random.Random(5)
    commits = [(f"t{rnd.randrange(3)}", v, NOW + dt.timedelta(minutes=20 * rnd.randrange(300)), rnd.choice(["DELETE", "WRITE"])) for v in range(80)]
    items = [(f"r{i}", f"t{rnd.randrange(4)}", NOW + dt.timedelta(minutes=10 * rnd.randrange(620))) for i in range(80)]
    got = er.pre_delete_version(spark.createDataFrame(items, "request_id string, table_full_name string, executed_at timestamp"),
                                spark.createDataFrame(commits, "table_full_name string, version bigint, commit_time timestamp, operation string"))
    want = {}
    for rid, table, at in items:
        near = sorted((abs((c - at).total_seconds()), v) for t, v, c, op in commits if t == table and op == "DELETE")
        if near:
            want[rid] = (near[0][1], near[0][0])
    assert {r.request_id: (r.matched_version, r.time_diff_seconds) for r in got.collect()} == want


# ---- disclosure and stream -------------------------------------------------------------------------

def test_report_escapes_and_pages(spark):
    table = spark.createDataFrame([(i, f"<b>{i}</b> & 'x'", "hidden") for i in range(25)], "id int, note string, other string")
    matches = table.select(F.lit("r").alias("request_id"), F.lit("silver.s.t").alias("table_full_name"), se.row_id(table, ["id"]).alias("row_id"), F.lit(2).cast("bigint").alias("n_rows"))
    scope = spark.createDataFrame([("r", "silver.s.t", ["id", "note"], ["other"])], "request_id string, table_full_name string, columns_included array<string>, columns_redacted array<string>")
    rows = di.disclosed_rows(matches, {"silver.s.t": table}, scope, {"silver.s.t": ["id"]})
    matched = spark.createDataFrame([("r", "silver.s.t", "direct", "class.name")], "request_id string, table_full_name string, provenance string, matched_column_or_tag string")
    items = di.access_items(rows, scope, matched, NOW).withColumn("retention_line", F.lit("kept"))
    requests = spark.createDataFrame([("r", "A & B", "me", "why <x>", "none", ["class.name"])], "request_id string, subject_display string, requested_by string, purpose string, recipients string, categories array<string>")
    comments = spark.createDataFrame([("silver.s.t", "about", {"id": "key"})], "table_full_name string, table_comment string, column_comments map<string,string>")
    systems = spark.createDataFrame([("r", None, "no system", None)], "request_id string, system_name string, statement string, safeguards_text string")
    parts = rp.render_reports(requests, items, rows, comments, systems, NOW, rows_per_page=4).orderBy("section", "page").collect()
    text = "".join(p.html for p in parts)
    assert len(parts) > 6 and text.startswith("<!doctype html>") and text.endswith("</html>")
    assert text.count("<tr>") == 26 and text.count("2 equal rows") == 25 and "50 rows" in text
    assert "<b>" not in text and "hidden" not in text and "&lt;b&gt;7&lt;/b&gt; &amp; &#x27;x&#x27;" in text and "why &lt;x&gt;" in text


def test_deadline_states(spark):
    day = dt.timedelta(days=1)
    rows = [("a", NOW - 40 * day, NOW - 10 * day), ("b", NOW - 40 * day, NOW - 9 * day), ("c", NOW - 30 * day, None), ("d", NOW - 31 * day, None)]
    df = spark.createDataFrame(rows, "request_id string, requested_at timestamp, completed_at timestamp")
    assert {r.request_id: r.sla_state for r in di.sla_state(df, NOW).collect()} == {"a": "on time", "b": "late", "c": "open", "d": "overdue"}


def test_stamps_keep_the_first_insert_time(spark, tmp_path):
    first = stamp(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int"), NOW)
    later = stamp(spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, n int"), NOW + dt.timedelta(days=1))
    got = {r.k: (r.v, r._inserted_at == NOW, r._updated_at == NOW) for r in merge_stamped(first, later, ["k"]).collect()}
    assert got == {1: ("a", True, True), 2: ("c", True, False), 3: ("d", False, False)}
    source, root, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    for i, rows in enumerate(([(1, "a", 1), (1, "b", 2)], [(1, "z", 3), (2, "y", 1)])):
        spark.createDataFrame(rows, "k int, v string, n int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, v string, n int").parquet(source)
        stamp_stream(stream, ["k"], "n", root, check, clock=F.lit(NOW + dt.timedelta(days=i))).awaitTermination()
    table = {r.k: (r.v, r._inserted_at, r._updated_at) for r in read_latest(spark, root, ["k"]).collect()}
    assert table == {1: ("z", NOW, NOW + dt.timedelta(days=1)), 2: ("y", NOW + dt.timedelta(days=1), NOW + dt.timedelta(days=1))}
    spark.createDataFrame([(1, "old", 2)], "k int, v string, n int").write.mode("append").parquet(source)
    stream = spark.readStream.schema("k int, v string, n int").parquet(source)
    stamp_stream(stream, ["k"], "n", root, check).awaitTermination()  # a late, older change: the batch's own clock, the newest values
    late = {r.k: r for r in read_latest(spark, root, ["k"]).collect()}[1]
    assert (late.v, late._inserted_at) == ("z", NOW) and late._updated_at > NOW + dt.timedelta(days=1)


def test_row_hash_is_not_the_match_id(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    hashed = hashing.with_row_key(df, "access").select("row_key").distinct()
    ids = df.select(se.row_id(df, None).alias("row_key")).distinct()
    assert hashed.join(ids, "row_key").count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_name_slots_of_many_tables_in_batches(spark):
    """no call of Python per table; equal names once, other tags and tags without a column left out."""
    tags = [("c", "s", f"t{k}", name, "class.name") for k in range(50) for name in ("first_1", "last_1", "first_2", "first_2")]
    tags += [("c", "s", "t0", "email", "class.email_address"), (None, "s", "u", "full_name", "class.name"), ("c", "s", "v", None, "class.name")]
    slots = se.assign_name_slots(spark.createDataFrame(tags, "table_catalog string, table_schema string, table_name string, column_name string, tag_name string"))
    rows = [tuple(r) for r in slots.collect()]
    want = [("c", "s", f"t{k}", name, name[-1]) for k in range(50) for name in ("first_1", "last_1", "first_2")]
    assert sorted(rows, key=repr) == sorted([*want, (None, "s", "u", "full_name", "person")], key=repr)
    assert slots.columns == ["table_catalog", "table_schema", "table_name", "column_name", "slot"]
    assert "FlatMapGroups" not in _plan(slots)


def test_default_columns_shuffles_items_only(spark):
    """columns are listed after the last join and not grouped again; NULLs and repeated rows as before."""
    matched = [("r1", "t"), ("r1", "t"), ("r2", "t"), (None, "t"), ("r1", None), ("r3", "u"), ("r3", "gone")]
    columns = [("t", "a", 1), ("t", "a", 1), ("t", "a", 9), ("t", "b", 2), ("t", None, 3), ("u", "x", 1), (None, "y", 1)]
    tags = [("t", "a", "class.p"), ("t", "a", "class.q"), ("t", "a", "class.q"), ("t", "b", "owner.team"), ("t", None, "class.z"), ("u", "x", "class.p"), ("t", "b", None)]
    searched = [("r1", "class.p"), ("r1", "class.q"), ("r1", "class.q"), ("r2", "class.p"), ("r2", None), (None, "class.p"), (None, "class.q")]
    frames = [
        spark.createDataFrame(rows, schema) for rows, schema in (
            (matched, "request_id string, table_full_name string"), (columns, "table_full_name string, column_name string, ordinal_position int"),
            (tags, "table_full_name string, column_name string, tag_name string"), (searched, "request_id string, tag_name string"))
    ]
    found = di.default_columns(*frames)
    want = []
    for r, t in set(matched):
        for t2, c, o in set(columns):
            if t is not None and t == t2:
                own = sorted(g for t3, c3, g in set(tags) if (t3, c3) == (t, c) and c is not None and g and g.startswith("class."))
                want.append((r, t, c, o, own[0] if own else None, all(r is not None and (r, g) in searched for g in own)))
    assert sorted((tuple(x) for x in found.collect()), key=repr) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not {"Join", "Aggregate"} & set(plan[: plan.index("Generate")].replace("+-", " ").split())
