"""The operators on pairs, groups and samples against brute force on small fixtures."""

import collections
import hashlib
import json
import os
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptloom.llm import bpe, copies, language, mixing, mojibake, packing, sampling, splits

needs_files = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZER_DIR), reason="no tokenizer files")


def fold(s):
    return "".join(c for c in s.lower() if not (c.isspace() or unicodedata.category(c)[0] == "P"))


def test_copies(spark):
    obj = {"q": "A b.", "n": 3, "in": {"x": [1, "Y"], "z": None}}
    turned = {"n": 3, "in": {"z": None, "x": [1, "y!"]}, "q": "ab"}
    data = [
        (1, "Hello, world", "cat"), (2, "hello  WORLD!", " Cat."), (3, "hello world", "dog"), (4, "Hello, world", "cat"), (5, None, "cat"), (6, " 　", "cat"), (7, "x", None),
        (8, json.dumps(obj), "cat"), (9, json.dumps(turned, indent=2), "[cat]"), (10, json.dumps({**obj, "in": {"x": ["Y", 1], "z": None}}), "cat"), (11, '{"q": broken', "cat"), (12, "{q broken}", "CAT"),
        (13, "!!", "cat"), (14, "?", "cat"), (15, "z" * 50_000, "cat"), (16, "Z" * 50_000 + ".", "cat"),
    ]
    df = spark.createDataFrame([(*r, 0, "") for r in data], "record_id long, prompt string, source string, h1 int, canon string")
    got = sorted(tuple(r) for r in copies.copies(df, "record_id", "prompt", "source").collect())
    assert got == [(1, 2), (1, 4), (8, 9), (11, 12), (13, 14), (15, 16)]
    counts = {r.keep_id: r.n_copies for r in copies.copy_counts(df, "record_id", "prompt", "source").collect()}
    assert counts[1] == 3 and counts[3] == 1 and sum(counts.values()) == 13
    assert copies.copies(df.limit(0), "record_id", "prompt", "source").count() == 0


def test_copies_of_a_hot_group(spark):
    df = spark.range(1, 3001).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("prompt"), F.lit("s").alias("source"))
    got = copies.copies(df, "record_id", "prompt", "source")
    assert got.filter("keep_id = 1").count() == 1999 and got.count() == 3000 - 51


def test_numbers_in_objects_keep_their_value(spark):
    texts = ['{"a": 1.5}', '{"a": 15}', '{"a": -3}', '{"a": 3}', '{"A" : 1.50}', '{"a": "3"}', '{"a": 3.0}', '{"a": 1e3}', '{"a": 1000}', '{"a": 1e999999999}', '{"a": true}', '{"a": "1.5"}']
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "record_id long, prompt string, source string")
    got = sorted(tuple(r) for r in copies.copies(df, "record_id", "prompt", "source").collect())
    assert got == [(0, 4), (1, 11), (3, 5), (3, 6), (7, 8)]
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    assert copies.json_node(deep) is None


def test_different_records_of_one_digest_stay_apart(spark, monkeypatch):
    real = copies._records
    monkeypatch.setattr(copies, "_records", lambda *a: real(*a).withColumns({"h1": F.lit(7).cast("long"), "h2": F.length("canon").cast("long")}))
    df = spark.createDataFrame([(1, "ab", "s"), (2, "A b", "s"), (3, "cd", "s"), (4, "xyz", "s"), (5, "xyz", "s"), (6, "ef", "S")], "record_id long, prompt string, source string")
    assert sorted(tuple(r) for r in copies.copies(df, "record_id", "prompt", "source").collect()) == [(1, 2), (4, 5)]
    assert sorted((r.keep_id, r.n_copies) for r in copies.copy_counts(df, "record_id", "prompt", "source").collect()) == [(1, 2), (3, 1), (4, 2), (6, 1)]


def words(s):
    return tuple("".join(" " if c.isspace() or unicodedata.category(c)[0] == "P" else c for c in s.lower()).split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_overlaps_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(splits, "HOT_WINDOW", hot)
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(12)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(1, 40))] for _ in range(60)]
    data = []
    for k in range(400):
        text = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            at = random.randrange(len(text) + 1)
            text[at : at + random.randint(0, 1)] = [random.choice(vocabulary)] * random.randint(0, 1)
        data.append((k, " ".join(text).upper() if k % 5 == 0 else ", ".join(text), random.choice(["train", "train", "Test ", "validation", None, "other"]), "s", "safe"))
    data += [(900, None, "train", "s", None), (901, " ", "test", "s", None), (902, "!?", "test", "s", "safe"), (903, "!", "train", "s", "safe"), (904, "w1 " * 3_000, "train", None, "safe"), (905, "w1 " * 3_000 + "x", "test", None, "unsafe\nS1")]
    df = spark.createDataFrame([(*r, "k") for r in data], "record_id long, prompt string, split string, source string, label string, key string")
    own = [(i, words(p), s.strip().lower()) for i, p, s, *_ in data if p and s and words(p) and i < 900]
    train, test = [x for x in own if x[2] == "train"], [x for x in own if x[2] in ("test", "validation")]
    want = {(min(i, j), max(i, j)) for i, a, _ in train for j, b, _ in test if distance(a, b) <= max(len(a), len(b)) // 6}
    got = [tuple(r) for r in splits.overlaps(df, "record_id", "prompt", "split").collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(904, 905)}
    report = splits.report(df, "record_id", "prompt", "split", "source", "label").collect()
    assert sum(r.n_pairs for r in report) == len(got) and sum(r.n_label_differs for r in report) == 1
    assert splits.overlaps(df.limit(0), "record_id", "prompt", "split").count() == 0


@pytest.mark.parametrize("n", [5, 6, 9, 10, 14, 15, 29, 30, 31, 44, 45, 101, 1000])
def test_cuts_are_disjoint_and_cheap(n):
    size = splits.window_of(n)
    cost = np.random.default_rng(n).integers(0, 50, (20, n - size + 1)).astype(float)
    start = splits.cuts(cost, n, size)
    assert start.shape == (20, splits.pieces_of(n)) and (start[:, 0] >= 0).all() and (start[:, -1] + size <= n).all() and (np.diff(start, axis=1) >= size).all()
    longest = max(m for m in range(n, 2 * n) if m - n <= m // 6)
    assert splits.pieces_of(n) > longest // 6
    if n == 10:
        brute = [min(r[a] + r[b] + r[c] for a in range(8) for b in range(a + size, 8) for c in range(b + size, 8)) for r in cost]
        assert np.allclose(np.take_along_axis(cost, start, axis=1).sum(axis=1), brute)


def test_overlaps_of_very_long_texts(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(3000)}" for _ in range(30_000)]
    near, far = list(long), list(long)
    for k in range(0, 30_000, 7):
        near[k] = "changed"
    for k in range(0, 30_000, 5):
        far[k] = "changed"
    data = [(1, " ".join(long), "train"), (2, " ".join(near), "test"), (3, " ".join(far), "test"), (4, " ".join(long[3_000:]), "test"), (5, " ".join(long[6_000:]), "test")]
    df = spark.createDataFrame(data, "record_id long, prompt string, split string")
    assert sorted(tuple(r) for r in splits.overlaps(df, "record_id", "prompt", "split").collect()) == [(1, 2), (1, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_banded_distance(seed):
    rng = np.random.default_rng(seed)
    n = 300
    la, lb = rng.integers(0, 15, n), rng.integers(0, 15, n)
    a, b = rng.integers(0, 3, (n, 15)), rng.integers(0, 3, (n, 15))
    most = rng.integers(0, 6, n)
    got = splits.within(a, la, b, lb, most)
    assert got.tolist() == [distance(a[i, : la[i]].tolist(), b[i, : lb[i]].tolist()) <= most[i] for i in range(n)]


SAMPLES = {
    "en": ["please tell me how to repair the old kettle before the rain", "the guest will open that window in the evening", "why does the large train stop without warning"],
    "bn": ["আমাকে শেখাও কীভাবে পুরোনো ঘড়িটি সারাই", "দুপুরের পরে দোকানগুলোর পাশে মেলা হবে", "কেন নদীটি শান্ত মনে হয় বলো"],
    "hi": ["मुझे सिखाओ कि पुरानी घड़ी कैसे सुधारूँ", "दोपहर के बाद दुकान के पास मेला होगा", "नदी शांत क्यों लगती है बताओ"],
}


def test_languages(spark):
    samples = spark.createDataFrame([(k, t) for k, l in SAMPLES.items() for t in l], "lang string, text string")
    data = [
        (1, SAMPLES["en"][0], "EN-us"), (2, SAMPLES["bn"][0], "hi"), (3, SAMPLES["hi"][1], " "), (4, f"{SAMPLES['en'][1]} / {SAMPLES['bn'][1]}", "bn"), (5, "কেন নদীটি laptop শান্ত মনে হয়", "bn_IN"),
        (6, None, "en"), (7, "  ", None), (8, "123 !!", None), (9, '{"question": "' + SAMPLES["bn"][2] + '", "topic of the day here": 3}', "BN"), (10, SAMPLES["en"][2] * 500, "unknown"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data], "record_id long, prompt string, lang string, label string")
    model = language.fit(samples, "lang", "text", [(df, "record_id", "prompt", "lang")])
    found = sorted(tuple(r) for r in language.mislabelled(df, "record_id", "prompt", "lang", model).collect())
    assert found == [(2, "bn"), (3, "hi"), (4, "bn"), (4, "en"), (10, "en")]
    parts = language.identify(df, "record_id", "prompt", "lang", model).collect()
    assert {r.rec_id for r in parts} == {1, 2, 3, 4, 5, 9, 10} and all(0 < r.confidence <= 1 for r in parts)
    assert language.identify(df.limit(0), "record_id", "prompt", "lang", model).count() == 0
    codes = ["bn", "bn-Latn", "en"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ("bn_Latn", "BN-latn-IN", "bn-BD", "und", "english", None)], "l string").select(language.code_of(F.col("l"), codes)).collect()]
    assert got == ["bn-Latn", "bn-Latn", "bn", None, None, None]


@pytest.mark.parametrize("share", [0.0, -3.8, -6.9])
def test_runs_of_four_words(share):
    def languages(n_words, nats):
        scores = np.tile(np.array([[0.0, -6.0]], np.float32), (24, 1))
        scores[10 : 10 + n_words] = [-nats, 0.0]
        rows = np.array([0, 24])
        path = language.best_paths(scores, rows, np.array([0.0, share], np.float32))
        first, _ = language._segments(path, rows)
        return path[first].tolist()

    assert languages(4, 4.0) == languages(4, 6.0) == [0, 1, 0]
    assert languages(1, 6.0) == languages(2, 6.0) == languages(3, 6.0) == [0]


def test_a_clear_word_outweighs_the_label():
    texts, labels = [t for l in ("bn", "hi") for t in SAMPLES[l]], [l for l in ("bn", "hi") for _ in SAMPLES[l]]
    model = language.Model.fit(texts, labels, ["bn", "hi"], {"bn": 40_000, "hi": 1_000})
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["bn", "bn", "hi"]), pa.array(["घड़ी", "zq", "घड़ी"])], ["rec_id", "label", "text"])
    found = [x for out in language._identify(model)(iter([batch])) for x in out.column("lang").to_pylist()]
    assert found == ["hi", "bn", "hi"]


def test_field_names_of_long_json(spark):
    names = {"plain": "x" * 200_000, "escapes": 'a\\"b\n: ' * 40_000, "quo\"ted": ["y", 'z": 1', {"in": "\\\\"}], "last": True}
    texts = [json.dumps(names), json.dumps({"q": 'say "q": no' * 20_000}), '{"open ' + "x" * 200_000, '"no object": 1']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    got = {r.id: r.out for r in df.select("id", language.without_fields(F.col("text")).alias("out")).collect()}
    want = texts[0]
    for k in ("plain", "escapes", "quo\"ted", "in", "last"):
        want = want.replace(f"{json.dumps(k)}:", " ", 1)
    assert got == {0: want, 1: texts[1].replace('"q":', " ", 1), 2: texts[2], 3: texts[3]}


def test_garbled_passages(spark):
    clean = ["আমার বন্ধু বলে", "শান্ত নদী é naïve “quiet” — café", "╔═╗ │ таблица вот", "अच्छा दिन", "x" * 1000]
    bad = {"cp1252": lambda s: "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in s.encode())}
    bad["latin-1"], bad["cp1251"], bad["mac_roman"], bad["cp437"] = (lambda s, c=c: "".join(bytes([b]).decode(c, "replace") if c != "cp1251" or b != 0x98 else "\x98" for b in s.encode()) for c in ("latin-1", "cp1251", "mac_roman", "cp437"))
    texts = list(clean)
    for f in bad.values():
        texts += [f"ok {f('বন্ধু')} ok", f(clean[0]), f("খগঘ নতুন")]
    texts += [bad["cp1252"](bad["cp1252"]("আমার নদী")), "caf� here", "a � b"]
    data = [*enumerate(texts), (900, None), (901, ""), (902, texts[6])]
    df = spark.createDataFrame([(i, t, "t") for i, t in data], "doc_id long, text string, token string")
    found = sorted(r.doc_id for r in mojibake.affected(df, "doc_id", "text").collect())
    assert found == [*range(len(clean), len(texts)), 902]
    fixed = {r.doc_id: r.restored_text for r in mojibake.restored(df, "doc_id", "text").collect()}
    assert fixed[5] == "ok বন্ধু ok" and fixed[6] == clean[0] == fixed[902]
    assert all(fixed[k] == clean[0] for k in range(6, 20, 3))
    assert fixed[len(texts) - 3] == "আমার নদী" and fixed[len(texts) - 2] == "café here" and fixed[len(texts) - 1] == "a � b"
    assert mojibake.affected(df.limit(0), "doc_id", "text").count() == 0


def test_pack_keeps_capacity_and_wastes_little():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(0, 101, 3000), np.full(10, 100), np.zeros(5, int), np.array([], int), np.array([51] * 7 + [49] * 7)):
        where = packing.pack(sizes, 100)
        fill = np.bincount(where, weights=sizes, minlength=1)
        assert fill.max(initial=0) <= 100
        least = max(1, -(-int(sizes.sum()) // 100), int((sizes > 50).sum()))  # no packing needs fewer
        assert len(fill) <= 1.03 * least + 1


def test_tiers_decide_the_packing():
    rng = np.random.default_rng(3)
    sizes = np.minimum(4096, rng.lognormal(6, 1, 5000).astype(int) + 1)
    packings = {}
    for tiers in (1, 2, 4, 6):
        where = packing.pack(sizes, 4096, tiers)
        fill = np.bincount(where, weights=sizes)
        assert fill.max() <= 4096 and sizes.sum() / (4096 * len(fill)) >= 0.99
        packings[tiers] = where.tolist()
    assert len({tuple(x) for x in packings.values()}) == 4
    assert packing.tier_of(np.array([4096, 2049, 2048, 1025, 1024, 512, 1]), 4096, 4).tolist() == [0, 0, 1, 1, 2, 3, 3]
    # one long document with a gap, filled from the shorter tier before that tier's own windows are packed
    assert packing.pack(np.array([60, 40, 50, 50]), 100, 2).tolist() == [0, 0, 1, 1]


def test_step_groups_are_even_over_a_spec(spark):
    rng = np.random.default_rng(1)
    data = [(s, c, int(rng.integers(1, 50))) for s, n in ((1, 130), (2, 3)) for c in range(n) for _ in range(2)]
    groups = packing.step_groups(spark.createDataFrame(data, "spec_id int, container_id long, n_tokens long")).collect()
    tokens, count = collections.Counter(), collections.Counter()
    for r in groups:
        count[r.spec_id, r.step_group] += 1
        tokens[r.spec_id, r.step_group] += sum(n for s, c, n in data if (s, c) == (r.spec_id, r.container_id))
    assert sorted(count[1, k] for k in range(3)) == [43, 43, 44] and count[2, 0] == 3 and len(count) == 4
    assert max(tokens[1, k] for k in range(3)) - min(tokens[1, k] for k in range(3)) < 150


@needs_files
def test_packed_documents(spark):
    data = [(i, "word " * (i * 7 % 90), "x") for i in range(300)] + [(900, None, "x"), (901, "", "x"), (902, "long " * 1000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, size string")
    specs = [(1, "byte_bpe_50k", 128), (2, "piece_bpe_32k", 64)]
    placed = packing.pack_documents(df, "doc_id", "text", specs, block_docs=100)
    rows = placed.collect()
    fill = collections.Counter()
    for r in rows:
        fill[r.spec_id, r.container_id] += r.n_tokens
    assert all(n <= dict((s[0], s[2]) for s in specs)[k] for (k, _), n in fill.items())
    assert {(r.spec_id, r.doc_id) for r in rows} == {(s, i) for s in (1, 2) for i, _, _ in data}
    own = sorted((r.first_token, r.n_tokens) for r in rows if r.spec_id == 1 and r.doc_id == 902)
    assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and all(n == 128 for _, n in own[:-1])
    total = packing.summary(placed, spark.createDataFrame([(a, b, c) for a, b, c in specs], "spec_id int, tokenizer string, capacity_tokens int")).collect()
    assert all(r.fill > 0.9 and r.n_docs == len(data) for r in total)
    assert packing.pack_documents(df.limit(0), "doc_id", "text", specs).count() == 0


def test_feasible_quotas():
    assert sampling.quotas([0.9, 0.1], [0, 150], [1000, 1000], 200) == [50, 150]
    assert sampling.quotas([0.5, 0.5], [0, 0], [10, 1000], 200) == [10, 190]
    assert sampling.quotas([0.9, 0.1], [150, 150], [1000, 1000], 200) == [100, 100]
    assert sampling.quotas([0.5, 0.5], [5, 5], [10, 20], 200) == [10, 20]
    assert sampling.quotas([1 / 3] * 3, [0] * 3, [100] * 3, 100) == [34, 33, 33]
    assert sampling.quotas([0.0, 1.0], [7, 0], [100, 100], 50) == [7, 43] and sampling.quotas([], [], [], 10) == [] and sampling.quotas([1.0], [3], [0], 10) == [0]


@pytest.mark.parametrize("reservoir", [None, 40])
def test_sample(spark, reservoir):
    data = [(i, "unsafe" if i % 4 else "safe", "big" if i % 10 else "small", 0) for i in range(4000)] + [(9001, None, "big", 0), (9002, "safe", None, 0), (None, "safe", "big", 0)]
    df = spark.createDataFrame(data, "record_id long, label string, source string, g int").repartition(3)
    targets = spark.createDataFrame([("safe", "big", 0.5, 1), ("unsafe", "big", 0.3, 1), ("unsafe", "small", 0.01, 30), ("safe", "small", 0.19, 1), ("safe", "none", 0.0, 5)], "label string, source string, target_share double, min_rows int")
    args = (df, "record_id", F.col("label"), F.col("source"))
    plan = sampling.plan(*args, targets, 0.25, reservoir=reservoir)
    drawn = sampling.sample(*args, plan).collect()
    got = collections.Counter((r.label, r.source) for r in drawn)
    own = [(i, l, s) for i, l, s, _ in data if i is not None]
    assert sum(got.values()) == 1001 and len({r.id for r in drawn}) == 1001 and got["unsafe", "small"] == 30 and got["safe", "small"] == 186 and abs(got["safe", "big"] * 3 - got["unsafe", "big"] * 5) < 10
    digest = lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest()[:12], i)
    assert {r.id for r in drawn} == {i for (l, s), n in got.items() for i in sorted((j for j, a, b in own if (a, b) == (l, s)), key=digest)[:n]}
    status = {(r.label, r.source): r.status for r in sampling.report(plan, spark).collect()}
    assert status["unsafe", "small"] == "minimum" and status["safe", "none"] == "no rows" and status["unsafe", "big"] == "below"
    none = sampling.plan(df.limit(0), *args[1:], targets, 0.25)
    assert sampling.sample(df.limit(0), *args[1:], none).count() == 0 and {r.status for r in sampling.report(none, spark).collect()} == {"no rows"}


def test_shares_moved_by_an_exhausted_category_are_not_met(spark):
    rows = [("safe", "a", 0.25, 1, 900, 250), ("unsafe", "a", 0.25, 1, 900, 247), ("safe", "b", 0.3, 1, 900, 300), ("safe", "c", 0.2, 1, 120, 120), ("unsafe", "c", 0.0, 20, 900, 20)]
    names = ("label", "source", "target_share", "min_rows", "available", "quota")
    plan = sampling.Plan(None, [dict(zip(names, r)) for r in rows])
    assert {(r.label, r.source): r.status for r in sampling.report(plan, spark).collect()} == {("safe", "a"): "above", ("unsafe", "a"): "above", ("safe", "b"): "above", ("safe", "c"): "exhausted", ("unsafe", "c"): "minimum"}
    few = [("safe", "a", 0.495, 1, 900, 495), ("safe", "b", 0.495, 1, 900, 495), ("safe", "c", 0.01, 60, 900, 60), ("safe", "d", 0.0, 5, 3, 3)]
    plan = sampling.Plan(None, [dict(zip(names, r)) for r in few])
    assert {r.source: r.status for r in sampling.report(plan, spark).collect()} == {"a": "below", "b": "below", "c": "minimum", "d": "exhausted"}
    reached = sampling.Plan(None, [dict(zip(names, r)) for r in (("safe", "a", 0.5, 1, 50, 50), ("safe", "b", 0.5, 1, 90, 50))])
    assert {r.status for r in sampling.report(reached, spark).collect()} == {"met"}


def test_mix(spark):
    data = [(i, f"alpha text {i}", "A.") for i in range(600)] + [(1000 + i, f"beta text {i}", "b") for i in range(60)] + [(5000, "beta text", None), (5001, None, "a"), (5002, " ", "a"), (5003, "other", "c")]
    df = spark.createDataFrame([(*r, 1) for r in data], "record_id long, prompt string, source string, size int")
    weights = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    args = (df, "record_id", "prompt", "source")
    fitted = mixing.fit(*args, weights, 0.5)
    mixed = mixing.mix(fitted)
    rows = mixed.collect()
    assert all(r.n_uses <= {"a": 1, "b": 3, None: 1}[r.source] for r in rows) and not {5001, 5002, 5003} & {r.id for r in rows}
    report = {r.source: r for r in mixing.report(fitted, mixed).collect()}
    assert abs(report["a"].actual_share - 0.7) < 0.05 and abs(report["b"].actual_share - 0.3) < 0.05 and report["gone"].status == "no rows"
    empty = mixing.fit(df.limit(0), *args[1:], weights, 0.5)
    assert mixing.mix(empty).count() == 0 and mixing.mix(mixing.fit(*args, weights.limit(0), 0.5)).count() == 0


def test_rows_without_a_source_count_by_their_posteriors(spark):
    """A third of all rows names no source; the smaller source is an eighth of them, and reaches its target with their help."""
    data = [(i, "common", "b" if i % 10 == 0 else "a") for i in range(2000)] + [(5000 + i, "common", None) for i in range(1000)]
    df = spark.createDataFrame(data, "record_id long, prompt string, source string").repartition(3)
    weights = spark.createDataFrame([("a", 0.86, 1), ("b", 0.14, 1)], "source string, target_share double, max_repeats int")
    fitted = mixing.fit(df, "record_id", "prompt", "source", weights, 0.5)
    p = np.array([r.posterior for r in fitted.members.filter("posterior is not null").limit(1).collect()])
    a, b = (n * (n + 0.5) / (n + 0.5 * mixing.BUCKETS) for n in (1800, 200))
    assert np.allclose(p, [[a / (a + b), b / (a + b)]])
    soft, named = mixing.rates(p, fitted.steps, fitted.most, fitted.start)[0], fitted.named_rates()
    sizes = 6 * (named * [1800, 200] + 1000 * soft * p[0])
    assert np.allclose(sizes, [0.86 * 9000, 0.14 * 9000], rtol=0.01)
    mixed = mixing.mix(fitted)
    used = collections.Counter(r.source for r in mixed.collect() for _ in range(r.n_uses))
    report = {r.source: r for r in mixing.report(fitted, mixed).collect()}
    assert abs(report["b"].mixed_size - 6 * (used["b"] + used[None] * p[0, 1])) < 0.01 and used[None] > 0
    assert {r.id for r in mixing.mix(fitted).collect()} == {r.id for r in mixed.collect()}


def test_posteriors_of_a_batch():
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(mixing.BUCKETS + 1, 3))
    lists = [[], [1, 2, 2], [5], [], list(range(40))]
    got = mixing._posteriors(matrix, np.array([x for l in lists for x in l], np.int64), np.cumsum([0, *map(len, lists)]))
    for own, p in zip(lists, got):
        score = np.exp(matrix[-1] + sum((matrix[x] for x in own), np.zeros(3)))
        assert np.allclose(p, score / score.sum())


def test_rates_reach_feasible_targets(spark):
    """Bounds bind for one source; the others still reach their targets."""
    data = [(i, f"x{i % 7} alpha", "a") for i in range(900)] + [(2000 + i, f"x{i % 7} beta", "b") for i in range(90)] + [(3000 + i, f"x{i % 5} gamma", "c") for i in range(30)] + [(4000 + i, "alpha beta gamma"[: 5 + i % 11], None) for i in range(300)]
    df = spark.createDataFrame(data, "record_id long, prompt string, source string")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 9), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    fitted = mixing.fit(df, "record_id", "prompt", "source", weights, 0.4)
    report = {r.source: r for r in mixing.report(fitted, mixing.mix(fitted)).collect()}
    named = fitted.named_rates()
    assert (named >= 0).all() and (named <= [1, 9, 2]).all() and named[2] == 2.0
    assert len(fitted.steps) <= mixing.STEPS and report["c"].status == "not met"
    p = np.array([r.posterior for r in fitted.members.filter("posterior is not null").collect()])
    size = np.array([r["size"] for r in fitted.members.filter("posterior is not null").collect()])
    whole = {r.k: r.s for r in fitted.members.filter("k is not null").groupBy("k").agg(F.sum("size").alias("s")).collect()}
    sizes = named * [whole[k] for k in range(3)] + (size * mixing.rates(p, fitted.steps, fitted.most, fitted.start)) @ p
    assert np.allclose(sizes[:2], np.array([0.5, 0.3]) * fitted.total, rtol=0.02)
