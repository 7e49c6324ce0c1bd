"""Worked examples of the column functions."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from stewardry.functions import durations, hashing, masks, normalise
from stewardry.functions.fuzzy import weighted_ratio
from stewardry.functions.slots import name_slots
from stewardry.functions.sql import FUNCTIONS, register_functions


def values(spark, kind, inputs, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    (masks.mask_email, "string", {"person@sample.example.com": "******@******.example.com", "a@b": "*@*.", None: None, "nope": "[REDACTED]", "a@.co": "*@.", "x@y@z.com": "*@*."}),
    (masks.mask_dob, "date", {dt.date(1985, 7, 23): dt.date(1980, 1, 1), None: None, dt.date(2000, 1, 1): dt.date(2000, 1, 1)}),
    (masks.mask_age_number, "int", {35: 30, -5: -10, 0: 0, None: None}),
    (masks.mask_age_text, "string", {"35": "30-39", "x": "[REDACTED]", "35.5": "[REDACTED]", None: "[REDACTED]", "-5": "-10--1"}),
    (masks.mask_ip, "string", {"192.168.1.100": "192.168.*.*", "2001:db8::1": "[REDACTED]", "999.1.1.1": "999.1.*.*", None: "[REDACTED]"}),
    (masks.mask_credit_card, "string", {"4111-1111-1111-1234": "**** **** **** 1234", "12": "**** **** **** 12", None: None}),
    (masks.mask_phone, "string", {"+44 7911 123456": "+44 *** *** ****", "0044 7911 123456": "+44 *** *** ****", "+447911123456": "+447 *** *** ****", "07911 123456": "[REDACTED]", None: "[REDACTED]"}),
    (masks.mask_location, "string", {"SW1A 1AA": "SW1A", "123 High Street, London, SW1A 1AA": "SW1A", "London": "[REDACTED]", "SW1A1AA": "[REDACTED]", None: "[REDACTED]"}),
    (durations.sla_minutes, "string", {"30m": 30, "4h": 240, "7d": 10080, "1y": 525960, "10y": 5259600, None: 1440, "": 1440, "1.5h": 1440, "30min": 1440, "d": 1440, "7 d": 10080, "99999999y": 1440}),
    (durations.retention_days, "string", {"interval 7 days": 7, "30 DAYS": 30, "interval 168 hours": 7, None: 7}),
    (normalise.norm_name, "string", {"Dr. José  Müller": "jose muller", "Mr": "", "Mary O'Brien": "mary obrien", "Smith-Jones, Ann": "smith-jones ann", "Mrs.. Ann": "ann", "Mrson Ann": "mrson ann", "ﬁona Ødegård": "fiona degard"}),
    (normalise.norm_phone, "string", {"+44 7911 123456": "911123456", "12345": "12345", "n/a": ""}),
    (normalise.norm_postcode, "string", {"27 My Street, N1 9PF": "N19PF", "London": "London", "sw1a1aa": "SW1A1AA"}),
]


@pytest.mark.parametrize("fn,kind,cases", CASES, ids=[c[0].__name__ for c in CASES])
def test_worked_examples(spark, fn, kind, cases):
    assert values(spark, kind, list(cases), fn) == list(cases.values())


def test_folding_equals_the_unicode_rule(spark):
    chars = [chr(c) for c in range(0x20, 0x2600)]
    ascii_of = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars}
    # Letters, marks and digits of other scripts have no ASCII form and stay; see the next test.
    chars = [c for c in chars if ascii_of[c] or (ord(c) < 0x250 and c != "µ") or unicodedata.category(c)[0] in "PSZC"]
    texts = [f"a{c}b" for c in chars] + ["José ﬁ ½ Ünïcödé", "plain", ""]
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert values(spark, "string", texts, normalise.fold_accents) == want


def test_names_of_other_scripts_stay_searchable(spark):
    names = ["Γιώργος Παππάς", "Иван Петров", "王小明", "Dr. Иван", "José Ω"]
    assert values(spark, "string", names, normalise.norm_name) == ["γιώργος παππάς", "иван петров", "王小明", "иван", "jose ω"]


def test_relative_time(spark):
    now = dt.datetime(2024, 6, 1)
    days = {0: "today", 1: "yesterday", 6: "6 days ago", 13: "last week", 29: "4 weeks ago", 59: "last month", 60: "2 months ago", -3: "today"}
    got = values(spark, "timestamp", [now - dt.timedelta(days=d) for d in days], lambda c: durations.relative_time(c, F.lit(now)))
    assert got == list(days.values())


def test_hashes(spark):
    subject = {"erasure": "0aedcf58a901bc0617d4ac98fa1de8410a9f77c899e43ff33942472ecdbb8bdf", "access": "f3ecc36e3b927c755ec67d9d8b1e8f1c4ccf9d7972e2c38e24fdbad0f1b572d7"}
    row = {"erasure": "beca74b4746c458553b96d36f1c9283c458d163573c0024887b677ac049a75d6", "access": "6d4e37cafc8df2488039263f4cc2253df4f8471285ff37039fbe8f65fd6d3718"}
    for kind in ("erasure", "access"):
        assert values(spark, "string", ["  A@B.com "], lambda c: hashing.hash_subject_ref(c, kind)) == [subject[kind]]
        assert values(spark, "string", ["1|x"], lambda c: hashing.hash_row_key(c, kind)) == [row[kind]]


def test_row_keys_keep_nulls_microseconds_and_separators(spark):
    rows = [(1, "a|b", "c", dt.datetime(2024, 1, 1, 0, 0, 0, 1)), (1, "a", "b|c", dt.datetime(2024, 1, 1, 0, 0, 0, 1)),
            (1, "a|b", "c", dt.datetime(2024, 1, 1, 0, 0, 0, 2)), (None, "a|b", "c", dt.datetime(2024, 1, 1, 0, 0, 0, 1)), (1, "a|b", None, None)]
    df = spark.createDataFrame(rows, "i int, a string, b string, t timestamp")
    keys = {r.row_key for r in hashing.with_row_key(df, "erasure").collect()}
    assert len(keys) == len(rows)
    again = {r.row_key for r in hashing.with_row_key(df.repartition(3).orderBy(F.rand()), "erasure").collect()}
    assert again == keys
    alone = hashing.with_row_key(df.filter("i = 1"), "erasure")
    assert {r.row_key for r in alone.collect()} < keys


def test_masks_hide_long_inputs(spark):
    texts = ["secretperson@hiddenhost.example.org", "+447911123456789", "4111111111111111", "10.20.30.40", "221b Baker Street, London, NW1 6XE", "plain text that is long"]
    for fn in (masks.mask_email, masks.mask_ip, masks.mask_credit_card, masks.mask_phone, masks.mask_location, masks.mask_sensitive):
        for text, out in zip(texts, values(spark, "string", texts, fn)):
            assert text not in out


@pytest.mark.parametrize("columns,slots", [
    (["buyer1_first", "buyer1_last", "seller1_first", "seller1_last"], {"buyer1": ["buyer1_first", "buyer1_last"], "seller1": ["seller1_first", "seller1_last"]}),
    (["first_name", "last_name", "line2_name"], {"person": ["first_name", "last_name"], "line2": ["line2_name"]}),
    (["firstname1", "lastname1", "firstname2", "lastname2"], {"1": ["firstname1", "lastname1"], "2": ["firstname2", "lastname2"]}),
    (["firstname_1", "lastname_1", "firstname_2", "lastname_2"], {"1": ["firstname_1", "lastname_1"], "2": ["firstname_2", "lastname_2"]}),
    (["first_name", "last_name"], {"person": ["first_name", "last_name"]}),
    (["full_name"], {"person": ["full_name"]}),
    (["buyer_first", "buyer_last", "payee_first", "payee_last"], {"buyer": ["buyer_first", "buyer_last"], "payee": ["payee_first", "payee_last"]}),
    (["firstname_driver", "lastname_driver", "firstname_owner", "lastname_owner"], {"driver": ["firstname_driver", "lastname_driver"], "owner": ["firstname_owner", "lastname_owner"]}),
    (["guest1first", "guest1last", "guest2first", "guest2last"], {"1": ["guest1first", "guest1last"], "2": ["guest2first", "guest2last"]}),
    (["name_1", "name_2", "name"], {"1": ["name_1"], "2": ["name_2"], "others": ["name"]}),
])
def test_name_slots(columns, slots):
    assert name_slots(columns) == slots


def test_weighted_ratio():
    assert weighted_ratio("ann hill", "ann hill") == 100
    assert weighted_ratio("hill ann", "ann hill") == 95
    assert weighted_ratio("", "ann") == 0
    assert weighted_ratio("abcd", "abxd") == 75
    assert weighted_ratio("hill", "anthony hill") == 90
    assert weighted_ratio("ann", "zzz") == 0
    assert weighted_ratio("new york mets", "new york meats") == pytest.approx(96.296, abs=0.01)


def test_sql_functions_answer_as_the_columns_do(spark):
    register_functions(spark, "t_")
    by_name = {fn.__name__: (fn, kind, list(cases)) for fn, kind, cases in CASES}
    for name, (fn, kind, inputs) in by_name.items():
        if name in FUNCTIONS:
            df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
            got = df.selectExpr("i", f"t_{name}(v) AS o").orderBy("i").collect()
            assert [r.o for r in got] == values(spark, kind, inputs, fn), name
    ages = spark.sql("""SELECT CAST(t_mask_age(v) AS STRING) AS o FROM VALUES (1, CAST(35 AS VARIANT)), (2, CAST('35' AS VARIANT)), (3, CAST(35.5D AS VARIANT)), (4, CAST(47.5 AS VARIANT)),
     (5, CAST('x' AS VARIANT)), (6, CAST(NULL AS VARIANT)), (7, CAST(true AS VARIANT)), (8, CAST(-5 AS VARIANT)) AS t(i, v) ORDER BY i""").collect()
    assert [r.o for r in ages] == ["30", "30-39", "30", "40", "[REDACTED]", "[REDACTED]", "[REDACTED]", "-10"]
    plan = spark.sql("SELECT t_mask_email(v) AS a, t_mask_ip(v) AS b, t_hash_access_row_key(v) AS c FROM VALUES ('a') AS t(v)")._jdf.queryExecution().executedPlan().toString()
    assert "t_mask" not in plan and "Python" not in plan
