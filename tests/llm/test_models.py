"""Operators that learn or place: secrets, decontamination, packing, language ID, HMM scores, sharding, pipeline."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stewardry.llm import decontam, langid, markov, packing, queries, secrets, sharding
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_digest(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in queries.documents(spark, SF).collect()}


def test_secret_base(spark):
    docs = texts(spark)
    for r in queries.op2_secret_field(spark, SF).collect():
        want = base_digest(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("crf")] == [s for s in want.split(",") if s]


@pytest.mark.parametrize(
    "text",
    ["token=token:abcdefg", "PassWord : 'abcdef'", "toKen = abcdef", "ſecret=abcdefgh", "token==abcdef", "api_key=x.y=zz123", "AKIAAKIA" + "A" * 14, "f" * 30 + "é" + "0" * 24, "secret=ab secret=abcdef"],
)
def test_secret_patterns(text):
    assert ",".join(f"{k}:{a}:{b}" for a, b, k in secrets.base_spans(text)) == base_digest(text)


def test_secret_field_finds_what_no_pattern_names(spark, odd, nothing):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    prose = "the of and to in a that be for it".split()
    rows = []
    for k in range(300):
        filler = " ".join(rng.choice(prose) for _ in range(30))
        kind = k % 4
        body = [f'password={hexes(18)}', f'token = "{hexes(40)}"', f"call {rng.randint(200, 999)}-555-{rng.randint(1000, 9999)} now", f"version 2021-{k % 12 + 1:02d}-10"][kind]
        rows.append((k, f"{filler} {body} {filler}"))
    rows.append((1000, f'the of credential = "{hexes(20)}" and to'))
    model = secrets.train(spark.createDataFrame(rows[:300], "doc_id long, text string"))
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model, keep=("doc_id",)).collect()}
    assert [s[0] for s in found[1000]] == ["crf"]
    start, end = found[1000][0][1:]
    assert re.fullmatch("[0-9a-f]{20}", rows[-1][1][start:end])
    assert not any(s[0] == "crf" for k in range(300) if k % 4 > 1 for s in found[k])  # phones and dates stay
    assert secrets.scan(odd, model, keep=("doc_id", "key")).count() == odd.count()
    assert secrets.scan(nothing, secrets.train(nothing), keep=("doc_id",)).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    model = secrets.FieldModel(rng.normal(size=(1 << secrets.FEATURE_BITS, 3)), rng.normal(size=(3, 3)))
    features = rng.integers(0, 1 << secrets.FEATURE_BITS, (4, 14))
    allowed = np.ones((4, 3), bool)
    scores, moves = model.weights[features].sum(axis=1), model.moves
    best = max(
        (x for x in np.ndindex(3, 3, 3, 3) if (x[0] != 2) and all((a, b) != (0, 2) for a, b in pairwise(x))),
        key=lambda x: sum(scores[k][t] for k, t in enumerate(x)) + moves[0][x[0]] + sum(moves[a][b] for a, b in pairwise(x)) + moves[x[-1]][0],
    )
    assert tuple(secrets.viterbi(features, allowed, model)) == best


def _plain_words(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text.translate(brute.LOWER))


def test_decontamination_recall(spark):
    """Items planted with edits up to the limit: at least 0.9 of what brute force finds, and nothing else."""
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows, n = [], 0
    for i, text in items:
        for share in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3):
            w = text.split()
            for _ in range(int(share * len(w))):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.insert(at, f"zz{n}"), lambda: w.pop(at), lambda: w.__setitem__(at, f"yy{n}")])()
            filler = [f"f{rng.randint(0, 500)}" for _ in range(120)]
            at = rng.randrange(100)
            rows.append((n, " ".join(filler[:at] + w + filler[at:])))
            n += 1
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r for r in found}
    want = {}
    for k, (d, text) in enumerate(rows):
        i, item = items[k // 6]
        w = _plain_words(item)
        edits = brute.best_stretch(w, _plain_words(text))
        if edits <= decontam.edits_allowed(len(w)):
            want[d, i] = edits
    hit = set(got) & set(want)
    assert len(hit) >= 0.9 * len(want) and len(want) > 150
    assert set(got) <= set(want)
    assert all(got[k]["edits"] == want[k] for k in hit)


def test_decontamination_edges(spark, odd, nothing):
    long_item = " ".join(f"w{k}" for k in range(700))
    bench = spark.createDataFrame([(1, odd.filter("doc_id = 6").first()["text"].split("\n")[0]), (2, None), (None, "x"), (3, "too short"), (4, long_item), (4, long_item)], "item_id long, text string")
    more = spark.createDataFrame([(50, "start " + long_item + " end")], "doc_id long, text string")
    rows = decontam.contaminated(odd.select("doc_id", "text").unionByName(more), bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in rows) == Counter({(6, 1): 1, (7, 1): 1, (50, 4): 2})
    docs = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        if r["item_id"] == 1:
            assert docs[r["doc_id"]][r["start"] : r["end"]] == docs[6].split("\n")[0]
    assert decontam.contaminated(nothing, bench).count() == 0
    assert decontam.contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_short_items_and_scripts_without_spaces(spark):
    """Items below eight words against brute force, and items whose words no spaces part."""
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(1 + k % 7))) for k in range(28)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    want = {}
    for d, text in rows:
        for i, item in items:
            w = item.split()
            edits = brute.best_stretch(w, text.split())
            if edits <= decontam.edits_allowed(len(w)):
                want[d, i] = edits
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == want and len(found) == len(want) > 150 and 1 in want.values()
    words = {k: t.split() for k, t in rows}
    for r in found:
        inside = dict(rows)[r["doc_id"]][r["start"] : r["end"]].split()
        assert brute.edit_distance(dict(items)[r["item_id"]].split(), inside) == r["edits"] and inside and words[r["doc_id"]]

    items = [(1, "What is the capital of France?"), (2, "中国的首都是哪里？"), (3, "日本の首都はどこですか"), (4, "เมืองหลวงของประเทศไทย"), (5, "?!"), (6, "𠀀𠀁")]
    rows = [(1, "q: what is the capital of france"), (2, "问题：中国的首都是哪里。答"), (3, "さて日本の首都はどこですかね"), (4, "xxเมืองหลวงของประเทศไทยyy"), (5, "é 𠀀𠀁 ?!"), (6, "中国 日本 เมือง what is"), (7, "中国的首都是那里")]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == {(1, 1): 0, (2, 2): 0, (3, 3): 0, (4, 4): 0, (5, 6): 0, (7, 2): 1}
    cut = {r["doc_id"]: dict(rows)[r["doc_id"]][r["start"] : r["end"]] for r in found}
    assert cut[2] == "中国的首都是哪里" and cut[4] == items[3][1] and cut[5] == "𠀀𠀁"


def check_packing(rows, docs, encode):
    """Every rule of the packing contract; returns the number of sequences."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for doc, text in docs.items():
        ids = np.array([*encode(text), 2], "<u4")
        mine = sorted(pieces[doc], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(mine):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    for group in bins.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(bins)


def hf_encode():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_packing_query(spark):
    rows = queries.op6_best_fit_packing(spark, SF).collect()
    used = check_packing(rows, texts(spark), hf_encode())
    assert used <= math.ceil(sum(r["length"] for r in rows) / 1024) * 1.02 + 1


def test_packing_odd_rows(spark, odd, nothing):
    path = queries.tokenizer_path()
    some = odd.filter("doc_id IS NOT NULL AND doc_id NOT IN (3, 11)")
    for grain in (10_000, 3):
        check_packing(packing.pack(some, tokenizer=path, grain=grain).collect(), {r["doc_id"]: r["text"] or "" for r in some.collect()}, hf_encode())
    assert packing.pack(odd, tokenizer=path).filter("piece = 0").count() == odd.count()
    assert packing.pack(nothing, tokenizer=path).count() == 0


def _fewest(sizes, capacity):
    """Fewest bins, by trying all placements."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= capacity and bins[j] not in bins[:j]:
                place(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_reduction_never_costs_a_bin():
    rng = random.Random(4)
    fixed_some = 0
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=21)
        left = counts.copy()
        fixed = packing.reduce_by_dominance(left, 20)
        n = sum(m for _, m in fixed)
        fixed_some += n
        rest = [s for s in range(20, 0, -1) for _ in range(left[s])]
        assert n + _fewest(rest, 20) == _fewest(sizes, 20)
        plan, _ = packing.plan_bins(counts, 20)
        used = Counter()
        for shape, m in plan:
            assert sum(a * b for a, b in shape) <= 20
            for a, b in shape:
                used[a] += b * m
        assert used == Counter(sizes)
    assert fixed_some > 100


def test_language_accuracy(spark):
    rows = queries.op7_language_mixture(spark, "/root/testdata/sf0.01").join(queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_mixture_and_edges(spark, odd, nothing):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    model = langid.train(docs)
    en = docs.filter("lang = 'en' AND n_chars > 3000").first()["text"][:2000]
    fr = docs.filter("lang = 'fr' AND n_chars > 3000").first()["text"][:1000]
    two = spark.createDataFrame([(1, en + " " + fr)], "doc_id long, text string")
    mix = dict(x.split(":") for x in langid.identify(two, model, keep=("doc_id",)).first()["lang_mix"].split(","))
    assert set(mix) == {"en", "fr"} and abs(float(mix["en"]) - 2 / 3) < 0.15
    rows = {(r["doc_id"], r["n"]): r for r in langid.identify(odd.withColumn("n", odd["n_chars"]), model, keep=("doc_id", "n")).collect()}
    assert all(rows[i, None]["lang_pred"] == "und" for i in (4, 5, 9, 13)) and rows[10, None]["lang_pred"] != "und"
    symbols = spark.createDataFrame([(1, "— ☃ 12")], "doc_id long, text string")
    assert langid.identify(symbols, model, keep=("doc_id",)).first()["lang_pred"] == "und"
    assert langid.identify(nothing, model, keep=("doc_id",)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(nothing), keep=("doc_id",)).collect()} == {"und"}


def test_hidden_markov_query(spark):
    docs = {i: [*brute.words(t), None] for i, t in texts(spark).items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, x in docs.items() if not held[i] for w in x)
    total, distinct = sum(c.values()), len(c)
    for r in queries.op9_hidden_markov(spark, SF).collect():
        x = docs[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(x), sum(c[w] > 0 for w in x), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in x), rel_tol=1e-9)
        assert r["score"] < 0


def test_word_counts_have_one_row_a_word_in_any_case(spark):
    df = spark.createDataFrame([(t,) for t in ("In USA La to", "in usa la TO", "IN Usa LA To", "iN usA lA tO")], "text string").repartition(4)
    parts = df.rdd.getNumPartitions()
    rows = markov.word_counts(df).collect()
    assert parts > 1 and sorted(r["n"] for r in rows) == [4] * 5 and len({r["word"] for r in rows}) == 5  # four words and the end


def test_forward_is_the_sum_over_paths_and_training_helps():
    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = markov.HiddenMarkov(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 3))))
    sequences = [np.array(x) for x in ([0, 1, 2, 2], [1], [2, 0], [0, 0, 0, 1, 2])]
    want = []
    for s in sequences:
        p = 0.0
        for path in np.ndindex(*(2,) * len(s)):
            q = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, w in zip(path, path[1:], s[1:], strict=False):
                q *= model.moves[a, b] * model.emit[b, w]
            p += q
        want.append(math.log(p))
    assert np.allclose(markov.forward(model, sequences), want)
    for _ in range(5):
        before = markov.forward(model, sequences).sum()
        start, moves, emissions, fit = markov.expected_counts(model, sequences)
        assert math.isclose(fit, before) and math.isclose(start.sum(), 4) and math.isclose(moves.sum(), 8) and math.isclose(emissions.sum(), 12)
        model = markov.HiddenMarkov(norm(start), norm(moves), norm(emissions))
        assert markov.forward(model, sequences).sum() >= before - 1e-9


def test_hidden_markov_odd_rows(spark, odd, nothing):
    rows = markov.score_texts(odd, queries.fold(7) == 2).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in rows)
    untrained = markov.score_texts(odd, odd["doc_id"].isNotNull() | odd["doc_id"].isNull()).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in untrained} == {(0, 0, 0.0)} and all(math.isfinite(r["score"]) for r in untrained)
    assert markov.score_texts(nothing, queries.fold(7) == 2).count() == 0


def check_shards(rows, shards, n):
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n and set(sizes) <= set(range(shards))
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_query(spark):
    docs = texts(spark)
    rows = queries.op10_stratified_sharding(spark, "/root/testdata/sf0.01").collect()
    check_shards(rows, 40, 1000)
    mixture = Counter((r["shard"], r["source"]) for r in rows)
    for source, n in Counter(r["source"] for r in rows).items():
        got = [mixture[k, source] for k in range(40)]
        assert max(got) - min(got) <= 2 and abs(sum(got) - n) == 0
    for r in queries.op10_stratified_sharding(spark, SF).collect():
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)


def test_sharding_odd_rows(spark, odd, nothing):
    for grain in (5000, 4):
        check_shards(sharding.interleave(odd, 7, grain=grain).collect(), 7, odd.count())
    assert sharding.interleave(nothing, 4).count() == 0
    plan = sharding.interleave(odd, 7)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline_stages(spark):
    """Each stage against what it should keep of the stage before."""
    docs = queries.documents(spark, SF)
    columns = docs.columns
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF).cache()
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        seen[name] = out
        before, kept = kept, out
        ids = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()} if name != "packing" else None
        was = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        if name == "language_id":
            assert set(ids) == {i for i, t in was.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            want = {i for i, _, least in brute.groups(sorted(was.items()), 5, 80, 100) if i == least}
            assert set(ids) == want
        elif name == "decontamination":
            items = [_plain_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = set()
            for i, t in was.items():
                w = _plain_words(t)
                found = set(w)
                if any(len(found & set(x)) >= 0.5 * len(set(x)) and brute.best_stretch(x, w) <= decontam.edits_allowed(len(x)) for x in items):
                    bad.add(i)
            assert set(ids) == set(was) - bad
        elif name == "packing":
            check_packing(out.collect(), was, hf_encode())
    assert corpus_pipeline.run(spark, SF).count() == seen["packing"].count()


def test_pipeline_stages_take_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        kept = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF)
        assert kept.count() >= 0


def test_pipeline_stages_decide_by_row(spark):
    """Rows with NULL or repeated ids stand for themselves in stages three and four."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id").first()["text"]
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    a, b, c, d, near = (words(30) for _ in range(5))
    rows = [(None, a), (None, b), (None, f"{near} x"), (7, f"{near} y"), (7, c), (5, d), (5, d), (8, ""), (8, " "), (8, None), (9, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert kept == Counter([(None, a), (None, b), (None, f"{near} x"), (7, c), (5, d), (8, ""), (8, " "), (8, None)])
    docs = spark.createDataFrame([(None, a), (None, f"{b} {item}"), (7, c), (7, item), (8, None), (8, d)], docs.schema)
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect())
    assert kept == Counter([(None, a), (7, c), (8, None), (8, d)])


def test_digitless_secrets_by_precision_and_recall(spark):
    """Half the secrets have no digit; half the keys are ones no pattern names. Found spans against planted ones."""
    rng = random.Random(11)
    prose = "the of and to in a that be for it with as was his they at this have from or".split()
    nouns = "Correct Horse Battery Staple River Window Garden Marble Copper Silver Yellow Purple".split()
    mixed = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    strong = lambda n: "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(n))
    made = [lambda: mixed(rng.randint(10, 20)), lambda: "".join(rng.sample(nouns, 4)), lambda: strong(rng.randint(10, 24)), lambda: strong(12)]

    def document(k, keys):
        words = [rng.choice(prose) for _ in range(60)]
        planted = []
        if k % 2 == 0:
            value = made[k // 2 % 4]()
            planted.append(value)
            words.insert(30, rng.choice([f'{rng.choice(keys)}="{value}"', f"{rng.choice(keys)}: {value}", f"{rng.choice(keys)} = {value}"]))
        else:
            words.insert(30, rng.choice(["the key is important", "a token of thanks", "McDonald and O'Brien", "version 2024-01-05", "call 555-010-2030", "JavaScript in PowerPoint"]))
        return (k, " ".join(words), planted)

    known, unknown = ["password", "secret", "api_key", "token"], ["passphrase", "credential", "auth_key", "login"]
    train = [document(k, known) for k in range(400)]
    test = [document(1000 + k, known + unknown) for k in range(400)]
    frame = lambda rows: spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = secrets.train(frame(train))
    found = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"]] for r in secrets.scan(frame(test), model, keep=(F.col("doc_id"), F.col("text"))).collect()}
    hits = sum(any(v in x for x in found[k]) for k, _, planted in test for v in planted)
    spans = sum(len(v) for v in found.values())
    right = sum(any(v in x for v in planted) for k, _, planted in test for x in found[k])
    recall, precision = hits / sum(len(p) for *_, p in test), right / spans
    print(f"secrets: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9
    base = sum(any(v in t[s:e] for s, e, _ in secrets.base_spans(t)) for _, t, planted in test for v in planted)
    assert hits > base  # more than the patterns alone


def test_naming_words_are_looked_for_only_where_a_part_of_one_is(monkeypatch):
    """op2_secret_field: the pattern of naming words is the slowest of a scan; most texts hold no part of any."""
    named = [f"{'x ' * 90}{word}{' y' * 90}" for word in ("PassPhrase", "pwd", "my_KEY", "Keys", "api", "AUTH", "login", "Credential", "token", "secret", "passwd")]
    assert all(secrets.windows(text) for text in named)

    class Slow:
        def finditer(self, text):
            raise AssertionError("looked for")

    monkeypatch.setattr(secrets, "_NAMING", Slow())
    assert secrets.windows("plain prose of no such word " * 20) == []
    for text in named:
        with pytest.raises(AssertionError, match="looked for"):
            secrets.windows(text)


def test_the_sample_of_secrets_is_bounded(spark, monkeypatch):
    """One id in a thousand rows, and one very long text, bring no more than the stated pieces to the driver."""
    monkeypatch.setattr(secrets, "SAMPLE_PIECES", 50)
    seen = []
    monkeypatch.setattr(secrets, "fit", lambda sequences, steps: seen.append([len(s[2]) for s in sequences]))
    rows = [(7, f"password=abc{k:06d}xyz and more words") for k in range(1000)] + [(8, " ".join(f"token = a1b2c3d{k}" for k in range(5000)))]
    secrets.train(spark.createDataFrame(rows, "doc_id long, text string"), sample_docs=300)
    assert len(seen[0]) == 50 and max(seen[0]) <= secrets.PIECE_TOKENS


def test_every_token_is_tagged_in_windows_and_between_them():
    """a secret in plain small letters far from any telling word; what the screen passes over is outside in full."""
    model = secrets.FieldModel(np.zeros((1 << secrets.FEATURE_BITS, 3)), np.zeros((3, 3)))
    model.weights[:, secrets.BEGIN] = -0.1
    model.weights[secrets._hashed("start=qzxw"), secrets.BEGIN] = 9.0
    filler = "and then some plain words follow here " * 30
    text = filler + "qzxwvbnmkl " + filler
    assert secrets.windows(text) == []
    assert secrets.added_spans(text, [], model) == [(len(filler), len(filler) + 10, "crf")]
    rng, words = np.random.default_rng(4), "apple oranges.pears ~grapes= melons== figs, berries/quince a bc Zürich ABCDEFG".split()
    for _ in range(60):
        field = secrets.FieldModel(rng.normal(scale=0.5, size=(1 << secrets.FEATURE_BITS, 3)) - [0, 1.2, 0.8], rng.normal(size=(3, 3)))
        line = " ".join(rng.choice(words, 12))
        _, features, allowed = secrets.sequence(line, 0, len(line))
        if not field.screen.may_hold(line, 0, len(line)):
            assert set(secrets.viterbi(features, allowed, field)) == {secrets.OUT}


def _fit_by_paths(sequences, steps, decay=1e-3):
    """The field's fit with every path of tags written out."""
    weights, moves = np.zeros((1 << secrets.FEATURE_BITS, 3)), np.zeros((3, 3))
    seen_w, seen_m = np.full(weights.shape, 1e-8), np.full((3, 3), 1e-8)
    for _ in range(steps):
        slope, slope_m = np.zeros_like(weights), np.zeros_like(moves)
        for features, allowed, tags in sequences:
            paths = [p for p in itertools.product(range(3), repeat=len(tags)) if all(allowed[k, x] for k, x in enumerate(p)) and (secrets.OUT, secrets.IN) not in zip((secrets.OUT, *p), p)]
            scores = [sum(weights[features[k], x].sum() for k, x in enumerate(p)) + sum(moves[a, b] for a, b in zip((secrets.OUT, *p), (*p, secrets.OUT))) for p in paths]
            chances = np.exp(scores) / np.exp(scores).sum()
            for path, share in [(tuple(tags), 1.0), *zip(paths, -chances)]:
                for k, (a, b) in enumerate(zip((secrets.OUT, *path), path)):
                    np.add.at(slope[:, b], features[k], share)
                    slope_m[a, b] += share
        slope, slope_m = slope / len(sequences) - decay * weights, slope_m / len(sequences) - decay * moves
        seen_w, seen_m = seen_w + slope**2, seen_m + slope_m**2
        weights, moves = weights + 0.5 * slope / np.sqrt(seen_w), moves + 0.5 * slope_m / np.sqrt(seen_m)
    return weights, moves


def test_fit_computes_tokens_only(monkeypatch):
    """op2: windows of unlike lengths are not padded to the longest, and the field is that of all paths written out."""
    rng, sizes = np.random.default_rng(6), []

    def window(length):
        allowed = np.ones((length, 3), bool)
        allowed[:, secrets.BEGIN] = rng.random(length) < 0.7
        allowed[0, secrets.IN] = False
        return rng.integers(0, 40, (length, 14)), allowed, np.where(allowed[:, secrets.BEGIN], rng.integers(0, 2, length), 0)

    mixed = [window(k) for k in (2, 5, 1, 3, 5, 1)]
    model = secrets.fit(mixed, 4)
    weights, moves = _fit_by_paths(mixed, 4)
    # A move that ends a window is no move of its tokens, so the last move of a path is counted in its score only.
    assert np.allclose(model.weights, weights, atol=1e-6) and np.allclose(model.moves, moves, atol=1e-6)
    summed = secrets._log_sum
    monkeypatch.setattr(secrets, "_log_sum", lambda x, axis: (sizes.append(x.size), summed(x, axis))[1])
    uneven = [window(100), *(window(2) for _ in range(200))]
    secrets.fit(uneven, 1)
    assert sum(sizes) < 2 * 9 * 500 + 3 * 201


def test_only_long_runs_bound_the_starts():
    """op2: starts of runs too short to hold a secret are not looked up, and those of all tokens of the others are."""
    model = secrets.FieldModel(np.zeros((1 << secrets.FEATURE_BITS, 3)), np.zeros((3, 3)))
    model.screen._top_start(["ab", "Zürichs", "abcdef", "x=1", "(user-name)"])
    assert set(model.screen.start) == {"Z", "ü", "rich", "abcd", "(", "user", ")"}
