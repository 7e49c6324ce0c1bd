"""Find every row that holds a subject's data: many subjects, many tables, one pass per table.

How a search runs:

1. *Scopes.* A scope says which columns of a table stand for which identifiers (from tags, or from
   column lineage). Scopes are catalog metadata and are planned on the driver.
2. *Specs.* What a subject asks of a scope, with equal questions of several subjects asked once.
3. *Keys.* Each spec picks its most selective identifier and turns it into equality keys. A
   containment (a name token, a piece of an address) becomes a fixed-length piece of the text
   looked for, which every row that contains it must also hold, so nothing is missed.
4. *Text rows* are the distinct texts that a scope sees in rows; rows with equal texts are one of them. Each
   offers the same kinds of keys as pairs of two numbers, text row and key hash, and meets the specs
   in one equi-join; most pairs end there. What is left is made distinct per text row and spec, meets the
   texts again, and is kept and scored if all conditions of the spec hold.
5. *Rows* meet what their texts hit by two hashes of the texts.

There is one plan for all sizes. The keys are read from a written table, so Spark knows their size and
broadcasts them or shuffles both sides; skewed keys are left to adaptive execution.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from stewardry.functions.fuzzy import weakest_score
from stewardry.functions.hashing import row_text
from stewardry.functions.normalise import (
    TAG_DOB,
    TAG_LOCATION,
    TAG_NAME,
    TAG_PHONE,
    compact_upper,
    fold_accents,
    is_clean_postcode,
    norm_phone,
    normalise_for_tag,
)
from stewardry.functions.slots import name_slots, slots_in_order
from stewardry.session import materialise

# --- fixed values --------------------------------------------------------------------------
FUZZY_THRESHOLD = 75
AUTO_SELECT_SCORE = 90
SLOWEST_TABLES = 15
# -------------------------------------------------------------------------------------------

#: Lengths of the text pieces used as containment keys; a text uses the longest that fits.
PIECES = (6, 3, 1)
POSTCODE_PIECE = 5

#: Kind of key to the length of its pieces; 0 stands for the whole text.
_PIECE_OF_KIND = {"equal": 0, "postcode": POSTCODE_PIECE, **{f"piece{n}": n for n in PIECES}}


#: Kinds of keys that questions about a tag may lead with; other tags are compared whole.
KEY_KINDS = defaultdict(lambda: ("equal",), {
    TAG_NAME: tuple(f"piece{n}" for n in PIECES),
    TAG_LOCATION: ("postcode", *(f"piece{n}" for n in PIECES)),
})


# ---- tag catalogue and identifiers -----------------------------------------------------------

def tagged_columns(column_tags: DataFrame, catalog: str | None = None) -> DataFrame:
    """Governed columns (``class.*`` tags), of one catalog or of all."""
    found = column_tags.filter(F.col("tag_name").startswith("class."))
    if catalog is not None:
        found = found.filter(F.col("table_catalog") == catalog)
    return found.select("table_catalog", "table_schema", "table_name", "column_name", "tag_name")


def normalise_subjects(subjects: DataFrame) -> DataFrame:
    """Identifiers ``(subject_id, tag, value)`` in comparable form, empty ones left out.

    An empty value would otherwise match every row without that identifier.
    """
    clean = subjects.select("subject_id", "tag", normalise_for_tag("tag", "value").alias("value"))
    return clean.filter(F.length(F.trim("value")) > 0).distinct()


def empty_conditions(subjects: DataFrame) -> DataFrame:
    """Identifiers that normalise to nothing and so are not searched."""
    clean = normalise_for_tag("tag", "value")
    return subjects.filter(clean.isNull() | (F.length(F.trim(clean)) == 0)).select("subject_id", "tag", "value")


def subject_refs(subjects: DataFrame) -> DataFrame:
    """One reference text per subject, ``tag=value; …`` in tag order."""
    pairs = F.array_sort(F.collect_list(F.struct("tag", "value")))
    text = F.array_join(F.transform("pairs", lambda p: F.concat(p.tag, F.lit("="), p.value)), "; ")
    return subjects.groupBy("subject_id").agg(pairs.alias("pairs")).select("subject_id", text.alias("subject_ref"))


def _token_variants(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(value, pos, token, variant) for each token of each distinct name, nicknames both ways."""
    tokens = names.select("value").distinct().select("value", F.posexplode(F.split("value", " ")).alias("pos", "token"))
    pairs = nicknames.select(*[F.lower(fold_accents(c)).alias(c) for c in ("nickname", "canonical")])
    both = pairs.select(F.col("nickname").alias("token"), F.col("canonical").alias("variant")).unionByName(
        pairs.select(F.col("canonical").alias("token"), F.col("nickname").alias("variant"))
    )
    other = tokens.join(both.distinct(), "token").select("value", "pos", "token", "variant")
    return tokens.select("value", "pos", "token", F.col("token").alias("variant")).unionByName(other).distinct()


def expand_tokens(subjects: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Every name token of every subject with its nickname variants, the token itself included."""
    names = normalise_subjects(subjects).filter(F.col("tag") == TAG_NAME)
    return names.join(_token_variants(names, nicknames), "value").select("subject_id", "pos", "token", "variant")


def assign_name_slots(column_tags: DataFrame) -> DataFrame:
    """Person slot of each name column; a group is one table's name columns.

    A table's names come together as one row, so a task asks for the slots of a whole batch of tables at once.
    """
    key = ["table_catalog", "table_schema", "table_name"]

    @F.pandas_udf("array<string>")
    def slots(columns: pd.Series) -> pd.Series:
        return columns.map(lambda names: slots_in_order(tuple(names)))

    names = column_tags.filter((F.col("tag_name") == TAG_NAME) & F.col("column_name").isNotNull())
    tables = names.groupBy(*key).agg(F.array_sort(F.collect_set("column_name")).alias("column_name"))
    both = tables.select(*key, F.explode(F.arrays_zip("column_name", slots("column_name").alias("slot"))).alias("c"))
    return both.select(*key, F.col("c.column_name").alias("column_name"), F.col("c.slot").alias("slot"))


# ---- scopes -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Scope:
    """Columns of one table that stand for identifiers, under the name that requests refer to."""

    name: str
    table: str
    columns: tuple[tuple[str, tuple[str, ...]], ...]  # (tag, columns)


def direct_scopes(column_tags: DataFrame, tables: Mapping[str, DataFrame]) -> list[Scope]:
    """Scopes from tags. Tables with the same set of tags share a scope name, so a subject's
    question is asked once for all of them."""
    found: dict[str, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
    for row in tagged_columns(column_tags).distinct().collect():
        full_name = f"{row.table_catalog}.{row.table_schema}.{row.table_name}"
        if full_name in tables:
            found[full_name][row.tag_name].add(row.column_name)
    return [
        Scope("|".join(sorted(tags)), full_name, tuple((t, tuple(sorted(tags[t]))) for t in sorted(tags)))
        for full_name, tags in sorted(found.items())
    ]


def direct_requests(identifiers: DataFrame, scopes: Sequence[Scope]) -> DataFrame:
    """What each subject asks of each scope: its identifiers of the kinds that the scope has."""
    pairs = sorted({(s.name, tag) for s in scopes for tag, _ in s.columns})
    scope_tags = identifiers.sparkSession.createDataFrame(pairs, "scope string, tag string")
    return identifiers.join(scope_tags, "tag").select("subject_id", "scope", "tag", "value")


def lineage_scopes(conditions: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[list[Scope], DataFrame]:
    """Scopes and requests from traced columns ``(subject_id, way, table_full_name, tag, columns, value)``.

    A scope is named after its way and its columns, so subjects whose lineage leads to the same
    columns share it; only the distinct scopes, which are catalog metadata, come to the driver.
    """
    item = ["subject_id", "way", "table_full_name"]
    known = conditions.filter(F.col("table_full_name").isin(*tables))
    plan = F.array_sort(F.collect_set(F.struct("tag", "columns")))
    digest = F.sha2(F.concat("table_full_name", F.lit("|"), F.to_json("plan")), 256)
    named = known.groupBy(*item).agg(plan.alias("plan")).withColumn("scope", F.concat("way", F.lit(":"), digest))
    named = materialise(named, "scopes")
    scopes = [
        Scope(row.scope, row.table_full_name, tuple((p.tag, tuple(p.columns)) for p in row.plan))
        for row in named.select("scope", "table_full_name", "plan").distinct().collect()
    ]
    requests = known.join(named.select(*item, "scope"), item)
    return scopes, requests.select("subject_id", "scope", "tag", "value")


# ---- specs and their keys --------------------------------------------------------------------

def _condition_kind() -> Column:
    tag, value = F.col("tag"), F.col("value")
    return (
        F.when(tag == TAG_NAME, F.lit("name"))
        .when((tag == TAG_LOCATION) & is_clean_postcode(value), F.lit("postcode"))
        .when(tag == TAG_LOCATION, F.lit("text"))
        .when(tag == TAG_DOB, F.lit("date"))
        .otherwise(F.lit("equal"))
    )


#: The most selective kind of identifier comes first; specs are keyed on it.
_SELECTIVITY = {"equal": 0, "postcode": 1, "date": 2, "name": 3, "text": 4}


def questions(requests: DataFrame, nicknames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, specs): which subject asks which spec, and the conditions of each distinct spec."""
    kinds = requests.withColumn("kind", _condition_kind())
    variants = _token_variants(requests.filter(F.col("tag") == TAG_NAME), nicknames)
    per_token = variants.groupBy("value", "pos").agg(F.array_sort(F.collect_set("variant")).alias("v"))
    tokens = per_token.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("t"))
    tokens = tokens.select("value", F.lit(TAG_NAME).alias("tag"), F.transform("t", lambda t: t.v).alias("tokens"))
    rank = F.lit(len(_SELECTIVITY))
    for kind, r in _SELECTIVITY.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    # A text of one or two letters is in nearly every row; such a condition leads only where there is no other.
    short = F.when(F.col("kind") == "name", _shortest(_telling(F.col("tokens"))) < PIECES[1]).otherwise(F.length("value") < PIECES[1])
    rank = F.when(F.col("kind").isin("name", "text") & short, rank + len(_SELECTIVITY)).otherwise(rank)
    condition = F.struct(
        rank.alias("rank"), "tag", "kind",
        F.when(F.col("kind").isin("equal", "date", "text"), F.lower("value")).otherwise(F.col("value")).alias("value"),
        F.coalesce("tokens", F.array().cast("array<array<string>>")).alias("tokens"),
    )
    full = kinds.join(tokens, ["tag", "value"], "left").select("subject_id", "scope", condition.alias("c"))
    asked = full.groupBy("subject_id", "scope").agg(F.array_sort(F.collect_set("c")).alias("conditions"))
    asked = asked.withColumn("spec_id", F.sha2(F.concat("scope", F.lit("|"), F.to_json("conditions")), 256))
    asked = materialise(asked, "asked")
    members = asked.select("subject_id", "spec_id", "scope")
    specs = asked.select("spec_id", "scope", "conditions").dropDuplicates(["spec_id"])
    return members, specs


def _piece_length(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= PIECES[0], PIECES[0]).when(n >= PIECES[1], PIECES[1]).otherwise(PIECES[2])


def _pieces(text: Column, length) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    last = F.length(text) - length + 1
    cut = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, length))
    return F.when(last >= 1, cut).otherwise(F.array().cast("array<string>"))


def _shortest(token: Column) -> Column:
    return F.array_min(F.transform(token, lambda v: F.length(v)))


def _telling(tokens: Column) -> Column:
    """The token with the longest shortest variant is the most telling one."""
    return F.element_at(F.array_sort(F.transform(tokens, lambda t: F.struct((-_shortest(t)).alias("n"), t.alias("t")))), 1)["t"]


def _spec_keys(specs: DataFrame) -> DataFrame:
    """One row per spec and key: (spec_id, scope, tag, kind, key)."""
    lead = specs.select("spec_id", "scope", F.element_at("conditions", 1).alias("c"))
    telling = _telling(F.col("c.tokens"))
    texts = (
        F.when(F.col("c.kind") == "name", telling)
        .when(F.col("c.kind") == "postcode", F.array(F.right("c.value", F.lit(POSTCODE_PIECE))))
        .otherwise(F.array("c.value"))
    )
    wanted = lead.select("spec_id", "scope", F.col("c.tag").alias("tag"), F.col("c.kind").alias("ckind"), F.explode(texts).alias("text"))
    exact = wanted.filter(F.col("ckind").isin("equal", "date", "postcode")).select(
        "spec_id", "scope", "tag",
        F.when(F.col("ckind") == "postcode", F.lit("postcode")).otherwise(F.lit("equal")).alias("kind"),
        F.col("text").alias("key"),
    )
    # Of all pieces of a text, take the one that fewest specs share: it is likely rare in the rows too.
    inside = wanted.filter(F.col("ckind").isin("name", "text"))
    length = _piece_length(F.col("text"))
    spread = inside.select(
        "spec_id", "scope", "tag", "text",
        F.concat(F.lit("piece"), length.cast("string")).alias("kind"),
        F.explode(F.array_distinct(_pieces(F.col("text"), length))).alias("key"),
    )
    shared = spread.groupBy("kind", "key").agg(F.count_distinct("spec_id").alias("n"))
    rarest = (
        spread.join(shared, ["kind", "key"])
        .groupBy("spec_id", "scope", "tag", "text", "kind")
        .agg(F.min(F.struct("n", "key")).alias("pick"))
        .select("spec_id", "scope", "tag", "kind", F.col("pick.key").alias("key"))
    )
    return exact.unionByName(rarest).distinct()


def _key_hash(scope: Column, tag: Column, kind: Column, key: Column) -> Column:
    """Keys meet by this number; what meets by chance fails the conditions later."""
    return F.xxhash64(scope, tag, kind, key)


# ---- rows and their keys -----------------------------------------------------------------------

def row_id(df: DataFrame, primary_key: Sequence[str] | None) -> Column:
    """Identity of a row: its declared key, which leaves the other columns unread, else all columns."""
    return F.sha2(row_text(primary_key or df.columns), 256)


def _texts(df: DataFrame, tag: str, columns: Sequence[str], fold: bool) -> Column:
    """The comparable texts of one identifier kind in a row."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def text(column: str) -> Column:
        c = F.col(f"`{column}`")
        if tag == TAG_DOB and isinstance(types[column], (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date")
        return c.cast("string")

    if tag == TAG_NAME:
        joined = [F.concat_ws(" ", *[text(c) for c in cols]) for cols in name_slots(list(columns)).values()]
        values = [F.lower(fold_accents(j) if fold else j) for j in joined]
    elif tag == TAG_PHONE:
        values = [norm_phone(text(c)) for c in columns]
    elif tag == TAG_LOCATION:
        values = [text(c) for c in columns]
    else:
        values = [F.lower(text(c)) for c in columns]
    return F.filter(F.array(*values), lambda v: v.isNotNull() & (v != ""))


@dataclass(frozen=True)
class KeyUse:
    """What rows must offer: keys of ``kind`` for ``tag`` in ``scope``."""

    scope: str
    tag: str
    kind: str


def key_hashes(texts: Column, use: KeyUse) -> Column:
    """Hashes of the keys of one kind that a row offers for one identifier."""
    shape = {"equal": lambda t: t, "postcode": compact_upper}.get(use.kind, F.lower)
    length = _PIECE_OF_KIND[use.kind]
    shaped = F.transform(texts, shape)
    offered = F.flatten(F.transform(shaped, lambda t: _pieces(t, length))) if length else shaped
    return F.transform(offered, lambda k: _key_hash(F.lit(use.scope), F.lit(use.tag), F.lit(use.kind), k))


def row_texts(df: DataFrame, scope: Scope, fold: bool) -> dict[str, Column]:
    """The comparable texts of a row by identifier kind."""
    return {tag: _texts(df, tag, columns, fold) for tag, columns in scope.columns}


def text_entries(texts: Mapping[str, Column]) -> Column:
    """Texts by identifier kind as an array, which rows can be grouped by, as they cannot by a map."""
    return F.array(*[F.struct(F.lit(tag).alias("key"), t.alias("value")) for tag, t in texts.items()])


def text_hashes() -> dict[str, Column]:
    """``row`` and ``same``, two hashes of the scope and texts of a row, which together stand for them.

    The numbers of texts are hashed too, as a hash of an array does not tell where the arrays in it end.
    """
    parts = ["scope", "texts", F.transform("texts", lambda e: F.size(e["value"]))]
    return {"row": F.xxhash64(*parts), "same": F.xxhash64(F.lit("same"), *parts)}


def text_rows(rows: DataFrame) -> DataFrame:
    """The distinct text rows ``(row, same, scope, texts)`` of ``rows``, with the texts as a map."""
    distinct = rows.select("scope", "texts").distinct().withColumns(text_hashes())
    return distinct.select("row", "same", "scope", F.map_from_entries("texts").alias("texts"))


def offered_keys(uses: Sequence[KeyUse]) -> Column:
    """Hashes of the keys that a text row offers; NULL for one whose scope nothing is asked of."""
    by_scope: dict[str, list[Column]] = defaultdict(list)
    for use in uses:
        by_scope[use.scope].append(key_hashes(F.coalesce(F.element_at("texts", use.tag), F.array().cast("array<string>")), use))
    keys = F.lit(None).cast("array<bigint>")
    for scope, hashes in by_scope.items():
        keys = F.when(F.col("scope") == scope, F.array_distinct(F.concat(*hashes))).otherwise(keys)
    return keys


def _table_rows(
    df: DataFrame, scopes: Sequence[Scope], uses: Sequence[KeyUse], asked: set[tuple[str, str]], fold: bool,
    primary_key: Sequence[str] | None,
) -> DataFrame | None:
    """One table's rows as each scope sees them: ``(table_full_name, row_id, scope, texts)``, the identity as bytes.

    ``asked`` holds the (scope, tag) pairs that some spec looks at; other columns are not read.
    """
    views = []
    for scope in scopes:
        texts = {tag: _texts(df, tag, columns, fold) for tag, columns in scope.columns if (scope.name, tag) in asked}
        if any(u.scope == scope.name and u.tag in texts for u in uses):
            views.append(F.struct(F.lit(scope.name).alias("scope"), text_entries(texts).alias("texts")))
    if not views:
        return None
    table = F.lit(scopes[0].table).alias("table_full_name")
    rows = df.select(table, F.unhex(row_id(df, primary_key)).alias("row_id"), F.explode(F.array(*views)).alias("view"))
    return rows.select("table_full_name", "row_id", "view.scope", "view.texts")


def _holds(condition: Column, texts: Column) -> Column:
    """Whether one condition of a spec holds for a row's texts."""
    cells = F.element_at(texts, condition.tag)

    def all_tokens(text: Column) -> Column:
        return F.forall(condition.tokens, lambda vs: F.exists(vs, lambda v: text.contains(v)))

    def one(text: Column) -> Column:
        return (
            F.when(condition.kind == "name", all_tokens(text))
            .when(condition.kind == "postcode", compact_upper(text).contains(condition.value))
            .when(condition.kind == "text", F.lower(text).contains(condition.value))
            .otherwise(text == condition.value)
        )

    return F.coalesce(F.exists(cells, one), F.lit(False))


def search(
    scopes: Sequence[Scope],
    requests: DataFrame,
    tables: Mapping[str, DataFrame],
    nicknames: DataFrame,
    primary_keys: Mapping[str, Sequence[str]] | None = None,
    fold_columns: bool = True,
    threshold: float | None = FUZZY_THRESHOLD,
) -> DataFrame:
    """Rows that satisfy all conditions of a subject: identifiers of one kind are alternatives over
    the columns of that kind, different kinds must all hold.

    Returns one row per (subject_id, table_full_name, row_id) with ``n_rows`` equal rows found,
    ``matched_on`` and the name ``score`` (NULL without a name). ``threshold`` drops weak name
    matches; NULL keeps all. ``scope`` names the scope that was asked. Accents are folded on both sides unless ``fold_columns`` is off.
    Search values are taken literally: ``%`` and ``_`` are no wildcards.
    """
    members, specs = questions(requests, nicknames)
    specs = materialise(specs, "specs")
    keys = materialise(_spec_keys(specs), "keys")
    uses = [KeyUse(*r) for r in keys.select("scope", "tag", "kind").distinct().collect()]  # a handful per scope
    looked_at = specs.select("scope", F.explode("conditions.tag").alias("tag")).distinct()
    asked = {tuple(r) for r in looked_at.collect()}
    by_table: dict[str, list[Scope]] = defaultdict(list)
    for scope in scopes:
        by_table[scope.table].append(scope)
    seen = [_table_rows(tables[name], own, uses, asked, fold_columns, (primary_keys or {}).get(name)) for name, own in sorted(by_table.items())]
    seen = [rows for rows in seen if rows is not None]
    schema = "subject_id string, scope string, table_full_name string, row_id string, n_rows bigint, matched_on string, score double"
    if not seen:
        return requests.sparkSession.createDataFrame([], schema)
    rows = reduce(DataFrame.unionByName, seen)
    known = materialise(text_rows(rows), "texts")
    offers = known.select("row", F.explode(offered_keys(uses)).alias("key_hash"))
    pairs = offers.join(keys.select("spec_id", _hash_of_key()), "key_hash").select("row", spec_hash()).distinct()
    hashed = rows.withColumns(text_hashes()).select("table_full_name", "row_id", "row", "same", F.lit(1).alias("n_rows"))
    found = kept_hits(scored_hits(known, pairs, specs), hashed, members, threshold)
    return found.withColumn("row_id", F.lower(F.hex("row_id")))


def _hash_of_key() -> Column:
    return _key_hash(F.col("scope"), F.col("tag"), F.col("kind"), F.col("key")).alias("key_hash")


def question_keys(specs: DataFrame) -> DataFrame:
    """One row per spec and key: (spec_id, scope, key_hash)."""
    return _spec_keys(specs).select("spec_id", "scope", _hash_of_key())


def spec_hash() -> Column:
    """Pairs name a spec by this number; what two specs share by chance fails the conditions of one later."""
    return F.xxhash64("spec_id").alias("spec")


def scored_hits(known: DataFrame, pairs: DataFrame, specs: DataFrame) -> DataFrame:
    """Text rows ``known(row, same, scope, texts)`` that met a spec in ``pairs(row, spec)`` and hold all its conditions.

    The weakest of several names counts; ``named`` tells the texts apart that names were compared with.
    """
    asked = specs.select(spec_hash(), "spec_id", F.col("scope").alias("_asked"), "conditions")
    met = known.join(pairs, "row").join(asked, "spec").filter("scope = _asked")
    every = F.forall("conditions", lambda c: _holds(c, F.col("texts")))
    names = F.filter("conditions", lambda c: c.kind == "name")
    hits = materialise(met.filter(every).select(
        "spec_id", "row", "same",
        F.array_join(F.array_distinct(F.transform("conditions", lambda c: c.tag)), ", ").alias("matched_on"),
        F.transform(names, lambda c: c.value).alias("names"),
        F.when(F.size(names) > 0, F.element_at("texts", TAG_NAME)).alias("name_texts"),
    ), "hits")
    keep = ["spec_id", "row", "same", "matched_on"]
    plain = hits.filter(F.size("names") == 0).select(*keep, F.lit(None).cast("bigint").alias("named"), F.lit(None).cast("double").alias("score"))
    named = hits.filter(F.size("names") > 0).select(*keep, F.xxhash64("name_texts").alias("named"), weakest_score("names", "name_texts").alias("score"))
    return plain.unionByName(named)


def kept_hits(scored: DataFrame, rows: DataFrame, members: DataFrame, threshold: float | None) -> DataFrame:
    """Rows ``(table_full_name, row_id, row, same, n_rows)`` whose texts were hit, for each subject that asks the spec.

    ``n_rows`` tells how many equal rows one stands for. All of a row's hits by a spec come into one task, so they are
    counted and the weakest score is taken there.
    """
    item = ["spec_id", "table_full_name", "row_id"]
    held = rows.join(scored, ["row", "same"]).repartition(*item)
    counted = held.groupBy(*item, "matched_on", "named").agg(F.sum("n_rows").cast("bigint").alias("n_rows"), F.min("score").alias("score"))
    weakest = counted.groupBy(*item, "n_rows", "matched_on").agg(F.min("score").alias("score"))
    return members.join(above_threshold(weakest, threshold), "spec_id").select(
        "subject_id", "scope", "table_full_name", "row_id", "n_rows", "matched_on", "score"
    )


def above_threshold(matches: DataFrame, threshold: float | None) -> DataFrame:
    """Matches without a name, and name matches whose ``score`` is ``threshold`` at least."""
    return matches if threshold is None else matches.filter(F.col("score").isNull() | (F.col("score") >= threshold))


def search_tables(
    subjects: DataFrame,
    tables: Mapping[str, DataFrame],
    column_tags: DataFrame,
    nicknames: DataFrame,
    **options,
) -> DataFrame:
    """Direct search of all tagged tables for all subjects; see :func:`search` for the options."""
    scopes = direct_scopes(column_tags, tables)
    identifiers = materialise(normalise_subjects(subjects), "identifiers")
    requests = direct_requests(identifiers, scopes)
    return search(scopes, requests, tables, nicknames, **options).drop("scope")


def preselected() -> Column:
    """Rows offered as already ticked: exact matches and strong name matches."""
    return F.col("score").isNull() | (F.col("score") >= AUTO_SELECT_SCORE)


def top_matches(matches: DataFrame, n: int | None = None) -> DataFrame:
    """All matches with ``n_found``, the number their (subject, table) has; or the ``n`` best of each for review.

    Matches are ranked only where ``n`` asks for it, after scoring. Rank limits are applied per task before the
    shuffle, so a subject with very many matches does not bring them all into one task. ``capped`` marks groups
    that hold more.
    """
    group = ["subject_id", "table_full_name"]
    total = matches.groupBy(*group).agg(F.count("*").alias("n_found"))
    if n is None:
        return matches.join(total, group)
    order = Window.partitionBy(*group).orderBy(F.desc_nulls_first("score"), "row_id")
    ranked = matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.join(total, group).withColumn("capped", F.col("n_found") > n)


def case_summary(matches: DataFrame) -> DataFrame:
    """Per subject: tables, catalogs, rows found and rows preselected."""
    return matches.groupBy("subject_id").agg(
        F.count_distinct("table_full_name").alias("n_tables"),
        F.count_distinct(F.substring_index("table_full_name", ".", 1)).alias("n_catalogs"),
        F.sum("n_rows").alias("rows_found"),
        F.sum(F.when(preselected(), F.col("n_rows")).otherwise(0)).alias("rows_selected"),
    )


def timing_summary(log: DataFrame) -> DataFrame:
    """Seconds and calls per search phase, the slowest phase first."""
    return log.groupBy("phase").agg(
        F.sum("seconds").alias("total_seconds"), F.count("*").alias("calls")
    ).orderBy(F.desc("total_seconds"))


def slowest_tables(log: DataFrame, n: int = SLOWEST_TABLES) -> DataFrame:
    """The ``n`` tables that took longest in total."""
    per_table = log.filter(F.col("table_name").isNotNull()).groupBy("table_name").agg(
        F.sum("seconds").alias("total_seconds"), F.count("*").alias("calls")
    )
    return per_table.orderBy(F.desc("total_seconds"), "table_name").limit(n)
