import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.functions import arrays, hashing, text
from promptloom.operators import attach, corpus, flatten, lowest, metrics, position, refusal, split, tokenbatch, trainlog
from promptloom.sources import readers, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_strip_is_python_strip(spark):
    cases = ["\tx\n", "\xa0x　", "\x85x\x1c", "​x ", "", " a  b ", "\x1d\x1e\x1f", None]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i").select(text.strip(F.col("c"))).collect()]
    assert got == [None if c is None else c.strip() for c in cases]
    blank = spark.createDataFrame([(c,) for c in cases], "c string").filter(text.not_blank(F.col("c"))).count()
    assert blank == sum(1 for c in cases if c and c.strip())


def test_names_and_labels(spark):
    df = spark.createDataFrame([(" [llamaguard]", "unsafe\nS9"), ("Template_Generated.", " Safe"), ("..", "n/a"), (None, None)], "s string, l string")
    assert rows(df.select(text.clean_name(F.col("s")), text.label_word(F.col("l")))) == [("llamaguard", "unsafe"), ("template_generated", "safe"), (None, None), (None, None)]


def test_label_rules_differ(spark):
    df = spark.createDataFrame([("safe",), ("Safe",), ("unsafe",), ("UNSAFE",), ("",), (None,)], "l string")
    got = rows(df.select(corpus.collapsed_label(F.col("l")), refusal.is_unsafe(F.col("l")), split.encoded(F.col("l"))))
    assert got == [("safe", False, 0), ("unsafe", False, None), ("unsafe", True, 1), ("unsafe", True, None), ("unsafe", False, None), ("unsafe", False, None)]


def test_union_and_statistics(spark):
    chat = spark.createDataFrame([("b", 0, " a ", "safe"), ("b", 1, "x", " "), ("b", 2, None, "safe"), ("b", 3, "a", "Safe")], "batch_file string, pos int, prompt_bn string, prompt_safety string")
    listed = spark.createDataFrame([("1", "a"), ("2", " ")], "id string, prompt string")
    both = corpus.combined(corpus.chat_prompts(chat), corpus.listed_prompts(listed, 1, "catqa"))
    assert sorted(r.prompt for r in both.collect()) == ["a", "a", "a"]
    assert rows(corpus.statistics(both)) == [(3, 1, 2, 33.333333, 66.666667)]
    assert rows(corpus.statistics(both.limit(0))) == [(0, 0, 0, 0.0, 0.0)]


def test_positions_are_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"), F.lit("x").alias("_other")).repartition(7)
    got = position.with_position(df, ["k"], "p", start=1).collect()
    assert len(got) == 5000 and all(r.p == r.k + 1 for r in got)
    assert position.with_position(df.limit(0), ["k"]).count() == 0


def test_flatten(spark):
    nested = json.dumps({"b": {"y": ["p", "p"], "x": []}, "a": {"z": ["q"]}})
    blocks = spark.createDataFrame([({"a": {"z": ["p", "q"]}}, 0), ({"a": {"z": ["r"]}}, 2)], "v map<string,map<string,array<string>>>, before int")
    assert sorted((r.p3, r.prompt) for r in flatten.nested_map(blocks, "v", offset="before").collect()) == [(0, "p"), (1, "q"), (2, "r")]
    got = rows(flatten.nested_map(flatten.from_json_text(spark.createDataFrame([(nested,)], "v string"), "v"), "v"))
    assert got == [(0, 0, 0, "p", "b", "y"), (0, 0, 1, "p", "b", "y"), (1, 0, 0, "q", "a", "z")]


def test_refusals(spark):
    data = [(0, "", "unsafe", "s"), *[(i, f"p{i}", "Unsafe" if i % 2 else "safe", None) for i in range(1, 60)]]
    df = spark.createDataFrame(data, "i long, prompt string, label string, source string")
    templates = refusal.with_template([f"t{k}" for k in range(20)], "t3")
    got = sorted(refusal.refusals(df, ["i"], templates).collect(), key=lambda r: int(r.id[4:]))
    assert [r.id for r in got][:2] == ["ref_0001", "ref_0003"] and len(got) == 30
    assert [r.template_index for r in got] == [k % 20 for k in range(1, 31)]
    assert {r.original_source for r in got} == {"unknown"} and {r.label for r in got} == {"safe"}
    hashed = refusal.refusals(df, ["i"], templates, "hashed")
    assert {r.template_index for r in hashed.collect()} == {None}
    assert refusal.refusals(df.filter("label = 'none'"), ["i"], templates).count() == 0
    assert refusal.refusals(df, ["i"], templates, "random").count() == 30
    assert rows(refusal.length_statistics(hashed.limit(0)))[0][0] == 0
    assert sum(r.n for r in refusal.template_usage(hashed).collect()) == 30
    big = spark.range(10_000, 10_001).select(F.format_string("ref_%04d", "id"))
    assert big.first()[0] == "ref_10000"
    with pytest.raises(ValueError):
        refusal.refusals(df, ["i"], [])


def test_splits(spark):
    df = spark.range(0, 1001).select("id", F.lit("p").alias("prompt"), F.lit("safe").alias("label"))
    exact = split.exact_split(df, "id")
    assert exact.filter("fold = 'test'").count() == math.ceil(0.2 * 1001) and exact.count() == 1001
    assert split.exact_split(df.limit(0), "id").count() == 0
    a, b = (split.hash_split(df.repartition(n), "id").filter("fold = 'test'").select("id") for n in (2, 5))
    assert a.exceptAll(b).count() == 0 and 120 < a.count() < 280
    assert rows(split.leakage(split.hash_split(df, "id"), "prompt", "fold")) == [(a.count(), a.count())]
    assert hashing.bucket(F.lit("x"), 5) is not None


def _auc(points):
    x, y = np.array([(0.0, 0.0), *points]).T
    return float(np.sum(np.diff(x) * (y[1:] + y[:-1]) / 2))


def test_metrics_against_numpy(spark):
    random.seed(3)
    data = [("m", random.randint(0, 1), round(random.random(), 1)) for _ in range(300)] + [("one", 1, 0.5), ("one", 1, 0.2), ("m", 1, None), ("m", None, 0.3)]
    df = spark.createDataFrame(data, "model string, y int, score double").withColumn("yhat", metrics.threshold(F.col("score")))
    own = [(y, s) for m, y, s in data if m == "m" and y is not None and s is not None]
    pos, neg = sum(y for y, _ in own), sum(1 - y for y, _ in own)
    cuts = sorted({s for _, s in own}, reverse=True)
    tp = [sum(y for y, s in own if s >= c) for c in cuts]
    fp = [sum(1 - y for y, s in own if s >= c) for c in cuts]
    auc = {r.model: r.roc_auc for r in metrics.roc_auc(df).collect()}
    assert abs(auc["m"] - _auc([(f / neg, t / pos) for t, f in zip(tp, fp)])) < 2e-6
    pr = {r.model: r.pr_auc for r in metrics.pr_auc(df).collect()}
    want = np.array([(0.0, 1.0), *[(t / pos, t / (t + f)) for t, f in zip(tp, fp)]])
    assert abs(pr["m"] - float(np.sum(np.diff(want[:, 0]) * (want[1:, 1] + want[:-1, 1]) / 2))) < 2e-6
    cells = {(r.model, r.y, r.yhat): r.n for r in metrics.confusion(df).collect()}
    assert sum(n for (m, _, _), n in cells.items() if m == "m") == len(own) and cells["one", 0, 0] == 0 and cells["one", 1, 1] == 0
    prf = {r.model: r for r in metrics.precision_recall_f1(df).collect()}
    assert prf["one"].precision == 0.0 and prf["one"].f1 == 0.0
    report = {(r.model, r.row): r for r in metrics.class_report(df).collect()}
    assert report["m", "unsafe"].recall == prf["m"].recall and report["m", "accuracy"].support == len(own)
    up = df.withColumn("score", F.exp("score"))
    assert {r.model: r.roc_auc for r in metrics.roc_auc(up).collect()} == auc
    assert metrics.comparison(df).count() == 10 and metrics.confusion(df.limit(0)).count() == 0


def test_training_log(spark):
    log = "start\nEpoch 1:\nTraining Loss: 0.5\nEval Loss: N/A\n---\nEpoch 2:\nTraining Loss: 0.25\nEval Loss: 0.3\n"
    assert rows(trainlog.epochs(spark.createDataFrame([(log,), (None,), ("",)], "l string"), "l")) == [(1, 0.5, None), (2, 0.25, 0.3)]


def test_arrays(spark):
    df = spark.createDataFrame([([],), ([1],), (list(range(4)),), (list(range(9)),), (None,)], "a array<int>")
    got = rows(df.select(arrays.fit_length(F.col("a"), 4, -1), arrays.attention_mask(F.col("a"), 4)))
    assert got == [([-1] * 4, [0] * 4), ([1, -1, -1, -1], [1, 0, 0, 0]), ([0, 1, 2, 3], [1] * 4), ([0, 1, 2, 3], [1] * 4), (None, None)]
    p = spark.createDataFrame([([1000.0, 1000.0],)], "s array<double>").select(arrays.softmax(F.col("s")), arrays.argmax(F.col("s"))).first()
    assert p[0] == [0.5, 0.5] and p[1] == 0


def test_attach_hot_and_cold_groups(spark):
    data = [(i, "hot" if i < 60 else f"g{i % 7}", None if i == 3 else "c") for i in range(100)]
    df = spark.createDataFrame(data, "id long, k string, c string")
    groups = df.groupBy("k", "c").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    want = sorted((i, min(j for j, k2, c2 in data if k2 == k and c2 == c)) for i, k, c in data if c is not None)
    for hot in (10, 1000):
        assert sorted((r.id, r.keep) for r in attach.attach(df, groups, ["k"], ["c"], ["keep"], hot_rows=hot).collect()) == want


def test_attach_with_several_groups_of_a_key(spark):
    df = spark.createDataFrame([(i, "hot" if i < 60 else "cold") for i in range(70)], "id long, k string")
    groups = spark.createDataFrame([("hot", "a", 60), ("hot", "b", 60), ("cold", "c", 10), ("gone", "d", 5)], "k string, v string, n long")
    for hot in (7, 1000):
        got = attach.attach(df, groups, ["k"], [], ["v"], hot_rows=hot, spread=["id"]).collect()
        assert sorted((r.id, r.v) for r in got) == sorted([(i, v) for i in range(60) for v in "ab"] + [(i, "c") for i in range(60, 70)])
    assert attach.attach(df, groups.limit(0), ["k"], [], ["v"]).count() == 0


def test_lowest_rows(spark, monkeypatch):
    monkeypatch.setattr(lowest, "SMALL", 3)
    random.seed(1)
    data = [(i, i % 3, random.choice([random.randrange(1 << 48), 5, 6, (1 << 48) - 1])) for i in range(600)]
    df = spark.createDataFrame(data, "id long, g int, priority long")
    wanted = {0: 77, 1: 200, 2: 0, 7: 4}
    inside, outside = lowest.split_lowest(df, wanted, ["id"])
    want = {i for g, n in wanted.items() for _, i in sorted((p, i) for i, h, p in data if h == g)[:n]}
    assert {r.id for r in inside.collect()} == want and {r.id for r in outside.collect()} == set(range(600)) - want


def test_running_sums(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7 % 3000).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 4).alias("v")).repartition(5)
    got = sorted((r.k, r.s, r.p, r.v) for r in position.with_running(df, [F.col("k").desc()], {"s": F.col("v")}, "p").collect())[::-1]
    assert [r[2] for r in got] == list(range(3000)) and [r[1] for r in got] == np.cumsum([r[3] or 0 for r in got]).tolist()
    assert position.with_running(df.limit(0), [F.col("k")], {"s": F.col("v")}).count() == 0


def test_batches_are_padded_to_their_longest(spark):
    df = spark.createDataFrame([(i, None if i == 2 else [i] * (i + 1)) for i in range(6)], "k int, a array<int>")
    got = {r.k: (r.batch, r.ids, r.attention_mask) for r in tokenbatch.padded_batches(df, ["k"], "a", 4, 5, -1).collect()}
    assert got[2] == (0, [-1] * 4, [0] * 4) and got[3] == (0, [3] * 4, [1] * 4) and got[0][1] == [0, -1, -1, -1] and got[5] == (1, [5] * 5, [1] * 5)


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('text,x\n"a\nb",1\n"say ""hi""",2\n,3\n', encoding="utf-8")
    assert [r.text for r in readers.prompt_csv(spark, str(tmp_path / "p.csv")).collect()] == ["a\nb", 'say "hi"', ""]
    for n, body in ((1, {"conversations": [{"prompt_bn": "a", "prompt_safety": "safe"}, {"prompt_bn": None}]}), (10, {"conversations": []}), (2, {"conversations": [{"prompt_bn": "c", "prompt_safety": "x"}]})):
        (tmp_path / f"batch_{n}.json").write_text(json.dumps(body), encoding="utf-8")
    (tmp_path / "batch_3.json").write_text('{"conversations": [{"prompt_bn": "tr', encoding="utf-8")
    (tmp_path / "batch_4.json").write_text("[1, 2]", encoding="utf-8")
    got = readers.chat_batches(spark, str(tmp_path / "batch_*.json")).orderBy("batch_file", "pos").collect()
    assert [(r.batch_file.split("/")[-1], r.prompt_bn) for r in got] == [("batch_1.json", "a"), ("batch_1.json", None), ("batch_2.json", "c")]
    assert readers.chat_batches(spark, str(tmp_path / "none_*.json")).count() == 0
    (tmp_path / "bare.json").write_text('[{"id": "1", "prompt": "p"}]', encoding="utf-8")
    (tmp_path / "wrapped.json").write_text('{"prompts": [{"id": "1", "prompt": "p"}]}', encoding="utf-8")
    for name in ("bare", "wrapped"):
        assert [(r.id, r.prompt) for r in readers.prompt_list(spark, str(tmp_path / f"{name}.json")).collect()] == [("1", "p")]
    assert readers.prompt_list(spark, str(tmp_path / "no.json")).count() == 0
    assert readers.records_or_conversations(spark, str(tmp_path / "bare.json")).count() == 1
    assert readers.records_or_conversations(spark, str(tmp_path / "batch_1.json")).count() == 2
    with pytest.raises(Exception):
        readers.records_or_conversations(spark, str(tmp_path / "wrapped.json"))
    (tmp_path / "results/b/final_model").mkdir(parents=True)
    (tmp_path / "results/a/final_model").mkdir(parents=True)
    (tmp_path / "results/c").mkdir(parents=True)
    assert readers.trained_models(spark, str(tmp_path / "results")) == ["a", "b"]
    (tmp_path / "nested.json").write_text('{"c": {"s": ["x", " y"]}}', encoding="utf-8")
    assert [r.prompt for r in readers.nested_categories(spark, str(tmp_path / "nested.json")).collect()] == ["x", " y"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "খ", None), (1, "ক", 5)], "i int, p string, t int")
    assert sinks.json_array(df, str(tmp_path / "x/out.json"), ["i"]) > 0
    assert json.loads((tmp_path / "x/out.json").read_text(encoding="utf-8")) == [{"i": 1, "p": "ক", "t": 5}, {"i": 2, "p": "খ", "t": None}]
    sinks.json_array(df, str(tmp_path / "w.json"), ["i"], wrap="prompts")
    assert list(json.loads((tmp_path / "w.json").read_text(encoding="utf-8"))) == ["prompts"]
    with pytest.raises(ValueError):
        sinks.json_array(df, str(tmp_path / "y.json"), ["i"], most=1)
    assert sinks.statistics_json(df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "o.json"), {"a": 1}).endswith("o_statistics.json")
    assert json.loads((tmp_path / "o_statistics.json").read_text()) == {"n": 2, "metadata": {"a": 1}}
    assert sinks.statistics_json(df.limit(0), str(tmp_path / "a.json_dir/o.json"), {}).endswith("a.json_dir/o_statistics.json")
    sinks.append_log(str(tmp_path / "log"), 1, 0.5, None)
    sinks.append_log(str(tmp_path / "log"), 2, 0.4, 0.3, {"f1": 0.5})
    assert rows(readers.training_log(spark, str(tmp_path / "log"))) == [(1, 0.5, None), (2, 0.4, 0.3)]
    scores = spark.createDataFrame([("m", 1, 0.9, 1), ("m", 0, 0.2, 0), ("m", 1, 0.4, 0)], "model string, y int, score double, yhat int")
    assert sinks.metrics_report(scores, str(tmp_path / "reports")) == ["m"]
    report = json.loads((tmp_path / "reports/m/metrics_report.json").read_text())
    assert report["confusion_matrix"] == [[1, 0], [1, 1]] and report["metrics"]["precision"] == 1.0 and report["classification_report"]["safe"]["support"] == 1
    assert "ROC AUC: 1.0000" in (tmp_path / "reports/m/metrics_report.txt").read_text()


def test_no_batch_files_no_corpus(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"id": "1", "prompt": "p"}]', encoding="utf-8")
    paths = (str(tmp_path / "batch_*.json"), str(tmp_path / "list.json"), str(tmp_path / "missing.json"))
    assert readers.corpus(spark, *paths) is None
    assert sinks.corpus_files(None, str(tmp_path / "out/c.json")) == {} and not (tmp_path / "out").exists()
    (tmp_path / "batch_2.json").write_text('{"conversations": [{"prompt_bn": "b", "prompt_safety": "S1"}]}', encoding="utf-8")
    (tmp_path / "batch_10.json").write_text('{"conversations": [{"prompt_bn": "a", "prompt_safety": "safe"}]}', encoding="utf-8")
    built = readers.corpus(spark, *paths)
    assert sinks.corpus_files(built, str(tmp_path / "out/c.json"), corpus.statistics(built), {"v": 1})["total_prompts"] == 3
    assert [r["prompt"] for r in json.loads((tmp_path / "out/c.json").read_text())] == ["a", "b", "p"] and (tmp_path / "out/c_statistics.json").exists()
    (tmp_path / "batch_3.json").write_text("[1", encoding="utf-8")
    (tmp_path / "batch_4.json").write_text("{}", encoding="utf-8")
    assert sorted((r.batch_file[-7:-5], r.message) for r in readers.bad_batches(spark, paths[0]).collect()) == [("_3", "no valid JSON object"), ("_4", "no conversations")]
    assert [r.prompt_bn for r in readers.chat_batches(spark, paths[0], ordered=True).collect()] == ["a", "b"]


def test_stream(spark, tmp_path):
    from promptloom.streaming import batches

    (tmp_path / "in").mkdir()
    (tmp_path / "in/b1.json").write_text('{"conversations": [{"prompt_bn": " a ", "prompt_safety": "safe"}, {"prompt_bn": "b", "prompt_safety": "S1"}]}')
    q = batches.label_counts(batches.chat_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("labels").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(rows(spark.table("labels"))) == [("safe", 1), ("unsafe", 1)]


def test_classifier_learns(spark):
    from promptloom.operators import classifier

    df = spark.createDataFrame([(f"good day {i}", 0) if i % 2 else (f"bad night {i}", 1) for i in range(60)], "text string, label int")
    got = classifier.predict(classifier.train(df, 256, 5), df, "m")
    assert metrics.precision_recall_f1(got).first().f1 == 1.0


def test_model_life_cycle(spark, tmp_path):
    from promptloom.operators import classifier

    df = spark.createDataFrame([(f"good day {i}", 0) if i % 2 else (f"bad night {i}", 1) for i in range(60)], "text string, label int")
    folder, log = str(tmp_path / "results"), str(tmp_path / "results/a_training_log.txt")
    args = (df, df, folder, "a")
    classifier.train_epochs(*args, epochs=1, features=64, log=lambda *e: sinks.append_log(log, *e))
    classifier.train_epochs(*args, epochs=3, features=64, log=lambda *e: sinks.append_log(log, *e))  # goes on with epoch 2
    losses = readers.training_log(spark, log).orderBy("epoch").collect()
    assert [r.epoch for r in losses] == [1, 2, 3] and losses[2].train_loss < losses[0].train_loss and losses[2].eval_loss is not None
    (tmp_path / "results/broken/final_model").mkdir(parents=True)
    names = readers.trained_models(spark, folder)
    scored, failed = classifier.evaluate_all(names, folder, df)
    assert names == ["a", "broken"] and list(failed) == ["broken"] and failed["broken"]
    assert {r.model for r in scored.collect()} == {"a"} and metrics.comparison(scored).count() == 5
    assert classifier.evaluate_all([], folder, df)[0].count() == 0


def test_epochs_take_the_steps_of_sparks_network(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    from promptloom.operators import classifier

    rng = np.random.default_rng(5)
    rows = [(" ".join(f"w{w}" for w in rng.zipf(1.6, 9) % 200) * (i % 7 > 0), int(rng.random() < 0.4)) for i in range(100)]
    df = spark.createDataFrame(rows, "text string, label int").coalesce(1)  # one block: the loss of Spark's network is the mean over rows
    network = MultilayerPerceptronClassifier(featuresCol="_features", labelCol="label", layers=[64, 2], maxIter=12, seed=1)
    model = Pipeline(stages=[*classifier._features(64), network]).fit(df)
    want, loss = model.stages[-1].weights.toArray(), model.stages[-1].summary().objectiveHistory[-1]
    for name, parts in (("one", df), ("uneven", df.repartition(7, "label", "text"))):
        log = []
        got = classifier.train_epochs(parts, df, str(tmp_path), name, 1, 12, 64, lambda *e: log.append(e))
        assert np.allclose(got.stages[-1].weights.toArray(), want, rtol=1e-5, atol=1e-7) and abs(log[0][1] - loss) < 1e-9
    assert [r.score for r in classifier.predict(got, df, "m").collect()] == pytest.approx([r.score for r in classifier.predict(model, df, "m").collect()], abs=1e-6)
    with pytest.raises(Exception, match="0 or 1"):
        classifier.train_epochs(spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "text string, label int"), df, str(tmp_path), "bad", 1, 2, 64)


def test_epochs_keep_no_dense_rows(spark, tmp_path):
    import threading

    from promptloom.operators import classifier

    spark.catalog.clearCache()
    df = spark.range(1000).selectExpr("concat('word', id % 50, ' other', id) AS text", "cast(id % 2 AS int) AS label")
    most, over = [0], threading.Event()

    def look():
        while not over.wait(0.01):
            most[0] = max(most[0], sum(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()))

    watch = threading.Thread(target=look)
    watch.start()
    try:
        classifier.train_epochs(df, df, str(tmp_path), "wide", epochs=1, iterations=2, features=1 << 16)
    finally:
        over.set()
        watch.join()
    assert most[0] < 10_000_000  # every feature of each row would be 524 MB
