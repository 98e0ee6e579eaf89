"""The reference's operators as named queries over the project's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptloom.functions import arrays, hashing, text
from promptloom.operators import classifier, corpus, flatten, metrics, position, refusal, split, tokenbatch, trainlog
from promptloom.sources import readers
from promptloom.storage import delete_at_exit, new_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CORPUS, CHAT, REFUSALS = "bangla_safety_prompt_dataset", "chat_batch_items", "bangla_refusal_dataset"
#: Consecutive ids whose prompts form one block of a nested list; results do not depend on it.
BLOCK = 1000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^{text.BLANKS}+|{text.BLANKS}+$', '', 'g')"


def _sql_bucket(column: str, n: int) -> str:
    return f"CAST(('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 8))::BIGINT % {n} AS INTEGER)"


def _combined(spark: SparkSession, d: str) -> DataFrame:
    return corpus.combined(
        corpus.chat_prompts(table(spark, d, CHAT)), corpus.listed_prompts(table(spark, d, "multijail_prompts"), 1, "multijail"), corpus.listed_prompts(table(spark, d, "catqa_prompts"), 2, "catqa")
    )


_COMBINED = f"""
SELECT 0 AS src_ord, batch_file AS file_ord, CAST(pos AS BIGINT) AS pos, {_sql_strip("prompt_bn")} AS prompt,
  CASE WHEN {_sql_strip("prompt_safety")} = 'safe' THEN 'safe' ELSE 'unsafe' END AS label, 'llamaguard' AS source
FROM chat_batch_items WHERE {_sql_strip("prompt_bn")} <> '' AND {_sql_strip("prompt_safety")} <> ''
UNION ALL SELECT 1, '', CAST(id AS BIGINT), {_sql_strip("prompt")}, 'unsafe', 'multijail' FROM multijail_prompts WHERE {_sql_strip("prompt")} <> ''
UNION ALL SELECT 2, '', CAST(id AS BIGINT), {_sql_strip("prompt")}, 'unsafe', 'catqa' FROM catqa_prompts WHERE {_sql_strip("prompt")} <> ''
"""


@query("q_union_sources", _COMBINED)
def q_union_sources(spark, d):
    return _combined(spark, d)


@query(
    "q_corpus_stats",
    f"""WITH c AS ({_COMBINED}), n AS (SELECT count(*) AS t, count(*) FILTER (WHERE label = 'safe') AS s, count(*) FILTER (WHERE label = 'unsafe') AS u FROM c)
SELECT t AS total_prompts, s AS safe_prompts, u AS unsafe_prompts, CASE WHEN t = 0 THEN 0.0 ELSE round(s * 100.0 / t, 6) END AS safe_percentage,
  CASE WHEN t = 0 THEN 0.0 ELSE round(u * 100.0 / t, 6) END AS unsafe_percentage FROM n""",
)
def q_corpus_stats(spark, d):
    return corpus.statistics(_combined(spark, d))


@query("q_source_dist", f"WITH c AS ({_COMBINED}) SELECT source, count(*) AS n FROM c GROUP BY source")
def q_source_dist(spark, d):
    return corpus.source_distribution(_combined(spark, d))


@query("q_source_subtotal", "SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM bangla_safety_prompt_dataset GROUP BY 1")
def q_source_subtotal(spark, d):
    return corpus.source_distribution(table(spark, d, CORPUS))


@query("q_strip", f"SELECT item_id, {_sql_strip('prompt_bn')} AS prompt, {_sql_strip('prompt_safety')} AS label FROM chat_batch_items")
def q_strip(spark, d):
    return table(spark, d, CHAT).select("item_id", text.strip(F.col("prompt_bn")).alias("prompt"), text.strip(F.col("prompt_safety")).alias("label"))


@query("q_nonempty", f"SELECT item_id FROM chat_batch_items WHERE {_sql_strip('prompt_bn')} <> '' AND {_sql_strip('prompt_safety')} <> ''")
def q_nonempty(spark, d):
    return table(spark, d, CHAT).filter((text.strip(F.col("prompt_bn")) != "") & (text.strip(F.col("prompt_safety")) != "")).select("item_id")


@query("q_nonempty_prompt", "SELECT record_id FROM bangla_safety_prompt_dataset WHERE prompt <> ''")
def q_nonempty_prompt(spark, d):
    return table(spark, d, CORPUS).filter(F.col("prompt") != "").select("record_id")


@query("q_default_field", "SELECT record_id, coalesce(label, 'unknown') AS label, coalesce(source, 'unknown') AS source, coalesce(prompt, '') AS prompt FROM bangla_safety_prompt_dataset")
def q_default_field(spark, d):
    return table(spark, d, CORPUS).select("record_id", *(text.default(F.col(c), v).alias(c) for c, v in (("label", "unknown"), ("source", "unknown"), ("prompt", ""))))


@query(
    "q_label_collapse",
    f"""SELECT label, count(*) AS n FROM (SELECT CASE WHEN {_sql_strip("prompt_safety")} = 'safe' THEN 'safe' ELSE 'unsafe' END AS label FROM chat_batch_items
WHERE {_sql_strip("prompt_safety")} <> '') GROUP BY label""",
)
def q_label_collapse(spark, d):
    stripped = text.strip(F.col("prompt_safety"))
    return table(spark, d, CHAT).filter(stripped != "").groupBy(corpus.collapsed_label(stripped).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("q_seq_id", f"SELECT CAST(row_number() OVER (ORDER BY CAST(id AS BIGINT)) AS VARCHAR) AS id, {_sql_strip('prompt')} AS prompt, 'jailbreak' AS category FROM multijail_prompts")
def q_seq_id(spark, d):
    rows = table(spark, d, "multijail_prompts").select(F.col("id").cast("bigint").alias("row"), text.strip(F.col("prompt")).alias("prompt"))
    return position.with_position(rows, ["row"], "n", start=1).select(F.col("n").cast("string").alias("id"), "prompt", F.lit("jailbreak").alias("category"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Categories nested as the reference's input has them. A list comes in blocks, so that none is built in one place;
    ``before`` is the number of its prompts in the blocks before."""
    rows = table(spark, d, "catqa_prompts").select(F.col("id").cast("bigint").alias("i"), "prompt", F.coalesce("category", F.lit("")).alias("c"), F.coalesce("sub_category", F.lit("")).alias("s"))
    rows = rows.filter(F.col("prompt").isNotNull()).withColumn("block", F.floor(F.col("i") / BLOCK))
    sizes = rows.groupBy("c", "s", "block").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("c", "s").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lists = rows.groupBy("c", "s", "block").agg(F.array_sort(F.collect_list(F.struct("i", "prompt"))).alias("l"))
    lists = lists.join(sizes.select("c", "s", "block", before.alias("before")), ["c", "s", "block"])
    return lists.select("before", F.create_map("c", F.create_map("s", F.col("l.prompt"))).alias("nested"), F.col("c").alias("key1"), F.col("s").alias("key2"))


_FLAT = "SELECT CAST(id AS BIGINT) AS i, prompt, coalesce(category, '') AS c, coalesce(sub_category, '') AS s FROM catqa_prompts WHERE prompt IS NOT NULL"


@query("q_flatten", f"SELECT row_number() OVER (PARTITION BY c, s ORDER BY i) - 1 AS p3, prompt, c AS category, s AS sub_category FROM ({_FLAT})")
def q_flatten(spark, d):
    return flatten.nested_map(_nested(spark, d), "nested", offset="before").select("p3", "prompt", "category", "sub_category")


@query("q_flatten_ids", f"SELECT CAST(row_number() OVER (ORDER BY c, s, i) AS VARCHAR) AS id, prompt, c AS category, s AS sub_category FROM ({_FLAT})")
def q_flatten_ids(spark, d):
    flat = flatten.nested_map(_nested(spark, d), "nested", ("key1", "key2"), offset="before")
    numbered = position.with_position(flat, ["key1", "key2", "p3"], "n", start=1)
    return numbered.select(F.col("n").cast("string").alias("id"), "prompt", "category", "sub_category")


@query("q_flatten_json", "SELECT category, sub_category, count(*) AS n FROM (SELECT coalesce(category, '') AS category, coalesce(sub_category, '') AS sub_category FROM catqa_prompts WHERE prompt IS NOT NULL) GROUP BY ALL")
def q_flatten_json(spark, d):
    texts = _nested(spark, d).select(F.to_json("nested").alias("nested"))
    return flatten.nested_map(flatten.from_json_text(texts, "nested"), "nested").groupBy("category", "sub_category").agg(F.count(F.lit(1)).alias("n"))


@query("q_unsafe_filter", "SELECT record_id FROM bangla_safety_prompt_dataset WHERE lower(coalesce(label, 'unknown')) = 'unsafe'")
def q_unsafe_filter(spark, d):
    return table(spark, d, CORPUS).filter(refusal.is_unsafe(F.col("label"))).select("record_id")


def _templates(spark: SparkSession, d: str) -> list[str]:
    """A table of fixed size."""
    return [r.refusal_response for r in table(spark, d, "refusal_templates").orderBy("template_index").collect()]


_UNSAFE = """SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS p FROM bangla_safety_prompt_dataset"""


@query(
    "q_round_robin",
    f"""WITH a AS ({_UNSAFE}), u AS (SELECT *, row_number() OVER (ORDER BY p) AS k FROM a WHERE prompt <> '' AND lower(label) = 'unsafe'), n AS (SELECT count(*) AS n FROM refusal_templates)
SELECT 'ref_' || CASE WHEN p < 10000 THEN lpad(CAST(p AS VARCHAR), 4, '0') ELSE CAST(p AS VARCHAR) END AS id, prompt, refusal_response, 'safe' AS label, 'template_generated' AS source,
  u.label AS original_label, coalesce(u.source, 'unknown') AS original_source, template_index
FROM u, n JOIN refusal_templates t ON t.template_index = u.k % n.n""",
)
def q_round_robin(spark, d):
    return refusal.refusals(table(spark, d, CORPUS), ["record_id"], _templates(spark, d))


@query(
    "q_hash_pick",
    f"""WITH a AS ({_UNSAFE}), u AS (SELECT *, 'ref_' || CASE WHEN p < 10000 THEN lpad(CAST(p AS VARCHAR), 4, '0') ELSE CAST(p AS VARCHAR) END AS rid FROM a WHERE prompt <> '' AND lower(label) = 'unsafe')
SELECT rid AS id, prompt, refusal_response, 'safe' AS label, 'template_generated' AS source, u.label AS original_label, coalesce(u.source, 'unknown') AS original_source, CAST(NULL AS INTEGER) AS template_index
FROM u JOIN refusal_templates t ON t.template_index = {_sql_bucket("rid", 20)}""",
)
def q_hash_pick(spark, d):
    return refusal.refusals(table(spark, d, CORPUS), ["record_id"], _templates(spark, d), "hashed")


@query("q_random_pick")
def q_random_pick(spark, d):
    return refusal.refusals(table(spark, d, CORPUS), ["record_id"], _templates(spark, d), "random")


@query(
    "q_template_lookup",
    "SELECT row_id, r.refusal_response, (SELECT min(template_index) FROM refusal_templates t WHERE t.refusal_response = r.refusal_response) AS template_index FROM bangla_refusal_dataset r",
)
def q_template_lookup(spark, d):
    templates = F.array(*map(F.lit, _templates(spark, d)))
    place = F.array_position(templates, F.col("refusal_response"))
    return table(spark, d, REFUSALS).select("row_id", "refusal_response", F.when(place > 0, place - 1).cast("int").alias("template_index"))


@query(
    "q_template_usage",
    "SELECT coalesce(refusal_response, '') AS refusal_response, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM bangla_refusal_dataset GROUP BY 1",
)
def q_template_usage(spark, d):
    return refusal.template_usage(table(spark, d, REFUSALS))


@query(
    "q_origin_counts",
    """SELECT 'original_label' AS kind, coalesce(original_label, 'unknown') AS value, count(*) AS n FROM bangla_refusal_dataset GROUP BY 2
UNION ALL SELECT 'original_source', coalesce(original_source, 'unknown'), count(*) FROM bangla_refusal_dataset GROUP BY 2""",
)
def q_origin_counts(spark, d):
    return refusal.origin_counts(table(spark, d, REFUSALS))


@query(
    "q_length_stats",
    """SELECT count(*) AS total_items, count(DISTINCT coalesce(refusal_response, '')) AS unique_templates_used, min(p) AS prompt_min, max(p) AS prompt_max, min(r) AS response_min, max(r) AS response_max,
round(avg(p), 6) AS prompt_avg, round(avg(r), 6) AS response_avg FROM (SELECT *, length(coalesce(prompt, '')) AS p, length(coalesce(refusal_response, '')) AS r FROM bangla_refusal_dataset)""",
)
def q_length_stats(spark, d):
    return refusal.length_statistics(table(spark, d, REFUSALS))


@query("q_display", "SELECT template_index, substr(refusal_response, 1, 30) || '...' AS shown FROM refusal_templates")
def q_display(spark, d):
    return table(spark, d, "refusal_templates").select("template_index", F.concat(F.substring("refusal_response", 1, 30), F.lit("...")).alias("shown"))


_ENCODED = "SELECT record_id, prompt AS text, CASE label WHEN 'safe' THEN 0 WHEN 'unsafe' THEN 1 END AS label FROM bangla_safety_prompt_dataset"


@query("q_label_encode", f"SELECT record_id, label FROM ({_ENCODED})")
def q_label_encode(spark, d):
    return table(spark, d, CORPUS).select("record_id", split.encoded(F.col("label")).alias("label"))


@query("q_dropna", f"SELECT * FROM ({_ENCODED}) WHERE text IS NOT NULL AND label IS NOT NULL")
def q_dropna(spark, d):
    return split.training_frame(table(spark, d, CORPUS), ("record_id",))


@query("q_value_counts", f"SELECT label, count(*) AS n FROM ({_ENCODED}) WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY label")
def q_value_counts(spark, d):
    return split.value_counts(split.training_frame(table(spark, d, CORPUS)), "label")


_SPLIT = f"SELECT *, CASE WHEN {_sql_bucket('record_id', 100)} < 20 THEN 'test' ELSE 'train' END AS fold FROM ({_ENCODED}) WHERE text IS NOT NULL AND label IS NOT NULL"


def _split(spark: SparkSession, d: str) -> DataFrame:
    return split.hash_split(split.training_frame(table(spark, d, CORPUS), ("record_id",)), "record_id")


@query("q_split_hash", f"SELECT record_id, fold FROM ({_SPLIT})")
def q_split_hash(spark, d):
    return _split(spark, d).select("record_id", "fold")


@query(
    "q_split_exact",
    f"""SELECT record_id, CASE WHEN row_number() OVER (ORDER BY substr(md5('42:' || CAST(record_id AS VARCHAR)), 1, 12), record_id) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS fold
FROM ({_ENCODED}) WHERE text IS NOT NULL AND label IS NOT NULL""",
)
def q_split_exact(spark, d):
    return split.exact_split(split.training_frame(table(spark, d, CORPUS), ("record_id",)), "record_id").select("record_id", "fold")


@query(
    "q_leakage",
    f"""WITH s AS ({_SPLIT}), t AS (SELECT DISTINCT text FROM s WHERE fold = 'train')
SELECT count(*) AS test_rows, count(t.text) AS leaked_rows FROM s LEFT JOIN t ON s.text = t.text WHERE fold = 'test'""",
)
def q_leakage(spark, d):
    return split.leakage(_split(spark, d), "text", "fold")


@query("q_threshold", "SELECT pred_id, CAST(score > 0.5 AS INTEGER) AS yhat FROM model_predictions")
def q_threshold(spark, d):
    return table(spark, d, "model_predictions").select("pred_id", metrics.threshold(F.col("score")).alias("yhat"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_predictions").select("model", "y", "score", metrics.threshold(F.col("score")).alias("yhat"))


_PRED = "SELECT model, y, score, CAST(score > 0.5 AS INTEGER) AS yhat FROM model_predictions"
_CELLS = f"""SELECT model, CAST(sum(y * yhat) AS DOUBLE) AS tp, CAST(sum((1 - y) * yhat) AS DOUBLE) AS fp, CAST(sum(y * (1 - yhat)) AS DOUBLE) AS fn, CAST(sum((1 - y) * (1 - yhat)) AS DOUBLE) AS tn
FROM ({_PRED}) WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY model"""
_PRF = f"""SELECT model, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM ({_CELLS})"""


@query(
    "q_confusion",
    f"""WITH m AS (SELECT DISTINCT model FROM ({_PRED}) WHERE yhat IS NOT NULL), g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(y, yhat))
SELECT m.model, g.y, g.yhat, (SELECT count(*) FROM ({_PRED}) p WHERE p.model = m.model AND p.y = g.y AND p.yhat = g.yhat) AS n FROM m, g""",
)
def q_confusion(spark, d):
    return metrics.confusion(_predictions(spark, d))


@query("q_prf", _PRF)
def q_prf(spark, d):
    return metrics.precision_recall_f1(_predictions(spark, d))


_RATIOS = f"""SELECT *, tp + fp + fn + tn AS n, CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS p0, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS r0,
CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f0, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p1, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r1,
CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1_, (tp + tn) / (tp + fp + fn + tn) AS acc, tn + fp AS s0, tp + fn AS s1 FROM ({_CELLS})"""


@query(
    "q_class_report",
    f"""WITH c AS ({_RATIOS})
SELECT model, 'safe' AS row, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM c
UNION ALL SELECT model, 'unsafe', round(p1, 6), round(r1, 6), round(f1_, 6), CAST(s1 AS BIGINT) FROM c
UNION ALL SELECT model, 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), CAST(n AS BIGINT) FROM c
UNION ALL SELECT model, 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1_) / 2, 6), CAST(n AS BIGINT) FROM c
UNION ALL SELECT model, 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6), round((f0 * s0 + f1_ * s1) / n, 6), CAST(n AS BIGINT) FROM c""",
)
def q_class_report(spark, d):
    return metrics.class_report(_predictions(spark, d))


_CUM = f"""SELECT model, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS pos, sum(n) OVER (PARTITION BY model) AS neg
FROM (SELECT model, score, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM ({_PRED}) WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY model, score)
WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""
_CURVE = f"SELECT model, score, fp / neg AS fpr, tp / pos AS tpr, tp / (tp + fp) AS prec FROM ({_CUM})"
_ROC_AUC = f"SELECT model, round(sum(a), 6) AS roc_auc FROM (SELECT model, (fpr - lag(fpr, 1, 0.0) OVER w) * (tpr + lag(tpr, 1, 0.0) OVER w) / 2 AS a FROM ({_CURVE}) WINDOW w AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model"
_PR_AUC = f"SELECT model, round(sum(a), 6) AS pr_auc FROM (SELECT model, (tpr - lag(tpr, 1, 0.0) OVER w) * (prec + lag(prec, 1, 1.0) OVER w) / 2 AS a FROM ({_CURVE}) WINDOW w AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model"


@query("q_roc_points", f"SELECT model, score AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM ({_CURVE})")
def q_roc_points(spark, d):
    return metrics.roc_points(_predictions(spark, d))


@query("q_roc_auc", _ROC_AUC)
def q_roc_auc(spark, d):
    return metrics.roc_auc(_predictions(spark, d))


@query("q_pr_points", f"SELECT model, score AS threshold, round(prec, 6) AS precision, round(tpr, 6) AS recall FROM ({_CURVE})")
def q_pr_points(spark, d):
    return metrics.pr_points(_predictions(spark, d))


@query("q_pr_auc", _PR_AUC)
def q_pr_auc(spark, d):
    return metrics.pr_auc(_predictions(spark, d))


@query("q_log_loss", f"SELECT model, round(avg(-ln(greatest(1e-7, CASE WHEN y = 1 THEN score ELSE 1 - score END))), 6) AS log_loss FROM ({_PRED}) WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY model")
def q_log_loss(spark, d):
    return metrics.log_loss(_predictions(spark, d))


_COMPARE = f"""WITH f AS ({_PRF}), r AS ({_ROC_AUC}), p AS ({_PR_AUC})
SELECT model, 'precision' AS metric, precision AS value FROM f UNION ALL SELECT model, 'recall', recall FROM f UNION ALL SELECT model, 'f1', f1 FROM f
UNION ALL SELECT model, 'roc_auc', roc_auc FROM r UNION ALL SELECT model, 'pr_auc', pr_auc FROM p"""


@query("q_model_comparison", _COMPARE)
def q_model_comparison(spark, d):
    return metrics.comparison(_predictions(spark, d))


@query("q_comparison_arrays", f"SELECT metric, list(model ORDER BY model) AS models, list(value ORDER BY model) AS values FROM ({_COMPARE}) GROUP BY metric")
def q_comparison_arrays(spark, d):
    return metrics.comparison_arrays(metrics.comparison(_predictions(spark, d)))


@query(
    "q_train_log",
    """SELECT vec_id, e AS epoch, round((vec_id + e) / 1000.0, 3) AS train_loss, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE round((vec_id + 2 * e) / 1000.0, 3) END AS eval_loss
FROM (SELECT CAST(vec_id AS INTEGER) AS vec_id FROM embeddings), (VALUES (1), (2), (3)) v(e)""",
)
def q_train_log(spark, d):
    """Logs built from the table's keys, three epochs each, and parsed again."""
    number = lambda x: F.format_string("%.3f", F.round(x / F.lit(1000.0), 3))
    blocks = []
    for e in (1, 2, 3):
        eval_ = F.when(F.col("vec_id") % 3 == 0, F.lit("N/A")).otherwise(number(F.col("vec_id") + 2 * e))
        blocks.append(F.concat(F.lit(f"Epoch {e}:\nTraining Loss: "), number(F.col("vec_id") + e), F.lit("\nEval Loss: "), eval_, F.lit("\n-----\n")))
    logs = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("vec_id"), F.concat(F.lit("start\n"), *blocks).alias("log"))
    return trainlog.epochs(logs, "log", ("vec_id",))


@query(
    "q_softmax",
    """SELECT vec_id, list_transform(e, lambda x: round(exp(x - m) / list_sum(list_transform(e, lambda z: exp(z - m))), 6)) AS p
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings)""",
)
def q_softmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(arrays.softmax(F.col("embedding").cast("array<double>")), lambda x: F.round(x, 6)).alias("p"))


@query("q_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS k FROM embeddings")
def q_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).alias("k"))


_IDS = "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE list_transform(range(0, CAST(length(text) % 700 AS BIGINT)), lambda x: CAST(x AS INTEGER)) END AS ids FROM documents"


@query(
    "q_pad",
    f"""SELECT doc_id, list_concat(ids[1:512], list_transform(range(0, CAST(greatest(512 - len(ids), 0) AS BIGINT)), lambda x: -1)) AS ids,
list_concat(list_transform(ids[1:512], lambda x: 1), list_transform(range(0, CAST(greatest(512 - len(ids), 0) AS BIGINT)), lambda x: 0)) AS attention_mask FROM ({_IDS}) WHERE ids IS NOT NULL""",
)
def q_pad(spark, d):
    n = F.length("text") % 700
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", arrays.fit_length(F.col("ids"), 512, -1).alias("ids"), arrays.attention_mask(F.col("ids"), 512).alias("attention_mask"))


_BATCHES = f"""SELECT doc_id, b AS batch, ids, max(len(ids)) OVER (PARTITION BY b) AS longest FROM (
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS b, coalesce(ids[1:512], []) AS ids FROM ({_IDS}))"""


@query(
    "q_pad_batches",
    f"""SELECT doc_id, batch, list_concat(ids, list_transform(range(0, CAST(longest - len(ids) AS BIGINT)), lambda x: 0)) AS ids,
list_concat(list_transform(ids, lambda x: 1), list_transform(range(0, CAST(longest - len(ids) AS BIGINT)), lambda x: 0)) AS attention_mask FROM ({_BATCHES})""",
)
def q_pad_batches(spark, d):
    n = F.length("text") % 700
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))
    return tokenbatch.padded_batches(table(spark, d, "documents").select("doc_id", ids.alias("ids")), ["doc_id"], "ids")


@query("q_upper", "SELECT DISTINCT model, upper(replace(model, '_', ' ')) AS title FROM model_predictions")
def q_upper(spark, d):
    return table(spark, d, "model_predictions").select("model", F.upper(F.replace("model", F.lit("_"), F.lit(" "))).alias("title")).distinct()


@query("q_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("q_bucket", f"SELECT doc_id, {_sql_bucket('doc_id', 20)} AS b FROM documents")
def q_bucket(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.bucket(F.col("doc_id"), 20).alias("b"))


@query(
    "q_lengths",
    "SELECT lang, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean FROM documents GROUP BY lang",
)
def q_lengths(spark, d):
    size = F.length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.round(F.avg(size), 6).alias("mean"))


@query("q_classifier")
def q_classifier(spark, d):
    """Train on the hash split's training fold, score its test fold."""
    rows = _split(spark, d)
    model = classifier.train(rows.filter("fold = 'train'").select("text", "label"))
    return classifier.predict(model, rows.filter("fold = 'test'").select("record_id", "text", "label"), "hashed_words", ("record_id",))


@query("q_model_lifecycle")
def q_model_lifecycle(spark, d):
    """Two models trained on the training fold in epochs and saved; both scored by name on the test fold, and compared."""
    rows = _split(spark, d).persist()
    folder = new_path(spark, "models")
    for name, features in (("words_1k", 1024), ("words_4k", 4096)):
        classifier.train_epochs(rows.filter("fold = 'train'"), rows.filter("fold = 'test'"), folder, name, epochs=2, features=features)
    delete_at_exit(spark, folder)
    rows.unpersist()
    scored, _ = classifier.evaluate_all(readers.trained_models(spark, folder), folder, rows.filter("fold = 'test'"))
    return metrics.comparison(scored)
