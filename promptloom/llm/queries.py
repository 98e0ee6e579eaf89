"""The queries of the ten problems over the project's tables, with production parameters, and SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm import bpe, budget, copies, encoding, language, mixing, mojibake, packing, sampling, splits, visual
from promptloom.functions import text as core_text
from promptloom.storage import table

CORPUS = "bangla_safety_prompt_dataset"
#: The sample's size as a share of the corpus's rows, the mix's as a share of its total prompt length.
SAMPLE_SHARE, MIX_SHARE = 0.1, 0.25


def _vocabularies(spark: SparkSession) -> str:
    """The folder of the public vocabularies, the same on all executors."""
    return spark.conf.get("spark.promptloom.tokenizers", bpe.TOKENIZER_DIR)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, CORPUS), "record_id", "prompt", "source")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_counts(table(spark, d, CORPUS), "record_id", "prompt", "source")


def p1_plain_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the prompts that are no JSON objects."""
    return copies.copy_counts(table(spark, d, CORPUS).filter(~F.coalesce(F.col("prompt").rlike(r"\A\s*\{"), F.lit(False))), "record_id", "prompt", "source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    prompts = visual.look_alike_pairs(table(spark, d, CORPUS), "record_id", "prompt")
    answers = visual.template_variants(table(spark, d, "bangla_refusal_dataset"), "row_id", "refusal_response", table(spark, d, "refusal_templates"), "template_index", "refusal_response")
    return prompts.select(F.lit("prompt").alias("field_name"), "a_id", "b_id").unionByName(answers.select(F.lit("refusal_response").alias("field_name"), "a_id", "b_id"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """The form to compare by, and the text to keep."""

    def both(name: str, key: str, text: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(text).alias("field_name"), F.col(key).alias("rec_id"), visual.visual_form_of(text).alias("form"), visual.clean_text_of(text).alias("text"))

    return both(CORPUS, "record_id", "prompt").unionByName(both("bangla_refusal_dataset", "row_id", "refusal_response"))


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    codes = sorted(r.lang for r in table(spark, d, "language_samples").select("lang").distinct().collect())
    slices = {"source": core_text.clean_name(F.col("source")), "lang": language.code_of(F.col("lang"), codes), "topic_area": F.col("topic_area")}
    return budget.budget(table(spark, d, CORPUS), "prompt", slices, "piece_bpe_32k", _vocabularies(spark))


def _sample_plan(spark: SparkSession, d: str) -> tuple:
    args = (table(spark, d, CORPUS), "record_id", core_text.label_word(F.col("label")), core_text.clean_name(F.col("source")))
    return args, sampling.plan(*args, table(spark, d, "sample_targets"), SAMPLE_SHARE)


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    args, plan = _sample_plan(spark, d)
    return sampling.sample(*args, plan).withColumnRenamed("id", "record_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.report(_sample_plan(spark, d)[1], spark)


def _language_model(spark: SparkSession, d: str) -> language.Model:
    labelled = [(table(spark, d, CORPUS), "record_id", "prompt", "lang"), (table(spark, d, "chat_batch_items"), "item_id", "prompt_bn", "lang")]
    return language.fit(table(spark, d, "language_samples"), "lang", "sample_text", labelled)


_TEXTS = ((CORPUS, "record_id", "prompt"), ("chat_batch_items", "item_id", "prompt_bn"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    model = _language_model(spark, d)
    parts = [language.mislabelled(table(spark, d, t), key, text, "lang", model).select(F.lit(text).alias("field_name"), "rec_id", "lang") for t, key, text in _TEXTS]
    return parts[0].unionByName(parts[1])


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    model = _language_model(spark, d)
    parts = [language.identify(table(spark, d, t), key, text, "lang", model).select(F.lit(text).alias("field_name"), "*") for t, key, text in _TEXTS]
    return parts[0].unionByName(parts[1])


def _mix(spark: SparkSession, d: str) -> tuple:
    fitted = mixing.fit(table(spark, d, CORPUS), "record_id", "prompt", "source", table(spark, d, "mix_weights"), MIX_SHARE)
    return fitted, mixing.mix(fitted)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].select(F.col("id").alias("record_id"), "source", "size", "n_uses")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d))


def _specs(spark: SparkSession, d: str) -> tuple[list[tuple[int, str, int]], DataFrame]:
    specs = table(spark, d, "container_specs")
    return [(r.spec_id, r.tokenizer, r.capacity_tokens) for r in specs.orderBy("spec_id").collect()], specs


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text", _specs(spark, d)[0], _vocabularies(spark))


def p9_summary(spark: SparkSession, d: str) -> DataFrame:
    specs, frame = _specs(spark, d)
    return packing.summary(packing.pack_documents(table(spark, d, "documents"), "doc_id", "text", specs, _vocabularies(spark)), frame)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlaps(table(spark, d, CORPUS), "record_id", "prompt", "split")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.report(table(spark, d, CORPUS), "record_id", "prompt", "split", "source", "label")


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return splits.evaluation_rows(table(spark, d, CORPUS), "record_id", "prompt", "split", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.affected(table(spark, d, "documents"), "doc_id", "text")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents"), "doc_id", "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k", _vocabularies(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_counts, p1_plain_counts, p2_found, p2_forms, p3_tokens, p4_sample, p4_report, p5_found, p5_report, p5_rows, p6_found, p6_segments, p7_mix, p7_report,
        p8_ids, p9_containers, p9_summary, p10_found, p10_restored,
    )
}

_BLANKS = core_text.BLANKS[1:-1]


def _sql_folded(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[\p{{P}}{_BLANKS}]+', '', 'g')"


def _sql_name(x: str) -> str:
    return rf"nullif(regexp_replace(lower({x}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'), '')"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"


# the categories with what there is, their feasible quotas (as in sampling.quotas: the level at which all of them add up), and all rows
_QUOTAS = rf"""rows AS (SELECT record_id, lower(regexp_extract({_sql_strip("label")}, '^(\p{{L}}+)', 1)) AS label, {_sql_name("source")} AS source FROM bangla_safety_prompt_dataset),
c AS (SELECT t.label, t.source, target_share AS s, CAST(min_rows AS BIGINT) AS m, (SELECT count(*) FROM rows r WHERE r.label = t.label AND r.source = t.source) AS hi FROM sample_targets t),
d AS (SELECT *, least(m, hi) AS lo FROM c),
g AS (SELECT least((SELECT CAST(floor({SAMPLE_SHARE} * count(*) + 0.5) AS BIGINT) FROM rows), sum(CASE WHEN s > 0 THEN hi ELSE lo END)) AS goal, sum(lo) AS low FROM d),
b AS (SELECT 0.0 AS b UNION SELECT lo / s FROM d WHERE s > 0 UNION SELECT hi / s FROM d WHERE s > 0),
f AS (SELECT b, sum(greatest(lo, least(hi, b * s))) AS f, sum(CASE WHEN s > 0 AND lo / s <= b AND b < hi / s THEN s ELSE 0 END) AS growing FROM b, d GROUP BY b),
l AS (SELECT CASE WHEN growing > 0 THEN b + (goal - f) / growing ELSE b END AS level FROM f, g WHERE f <= goal + 1e-9 ORDER BY b DESC LIMIT 1),
e AS (SELECT d.*, goal, CASE WHEN low >= goal THEN lo * goal / greatest(1, low) ELSE greatest(lo, least(hi, level * s)) END AS exact FROM d, g LEFT JOIN l ON true),
w AS (SELECT *, CAST(floor(exact + 1e-9) AS BIGINT) AS whole FROM e),
q AS (SELECT *, whole + CASE WHEN row_number() OVER (ORDER BY round(exact - whole, 6) DESC, label, source) <= goal - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM w)"""

SQL: dict[str, str] = {
    "p1_plain_counts": rf"""SELECT min(record_id) AS keep_id, min(name) AS source, count(*) AS n_copies FROM (SELECT record_id, {_sql_folded("source")} AS s, {_sql_name("source")} AS name, {_sql_folded("prompt")} AS p
FROM bangla_safety_prompt_dataset WHERE source IS NOT NULL AND prompt IS NOT NULL AND NOT regexp_full_match(prompt, '[{_BLANKS}]*') AND NOT regexp_matches(prompt, '^\s*\{{')) GROUP BY s, p""",
    "p4_sample": f"""WITH {_QUOTAS}, o AS (SELECT r.*, quota, row_number() OVER (PARTITION BY r.label, r.source ORDER BY substr(md5('0:' || CAST(record_id AS VARCHAR)), 1, 12), record_id) AS k
FROM rows r JOIN q ON r.label = q.label AND r.source = q.source) SELECT record_id, label, source FROM o WHERE k <= quota""",
    "p4_report": f"""WITH {_QUOTAS}, a AS (SELECT *, coalesce(quota / nullif(sum(quota) OVER (), 0), 0.0) AS share FROM q)
SELECT label, source, round(s, 6) AS target_share, m AS min_rows, hi AS available, quota, round(share, 6) AS actual_share,
CASE WHEN hi = 0 THEN 'no rows' WHEN quota >= hi AND (share < s * {1 - sampling.TOLERANCE} OR quota < m) THEN 'exhausted' WHEN share > s * {1 + sampling.TOLERANCE} AND quota = m THEN 'minimum'
WHEN share > s * {1 + sampling.TOLERANCE} THEN 'above' WHEN share < s * {1 - sampling.TOLERANCE} THEN 'below' ELSE 'met' END AS status FROM a""",
    "p5_rows": rf"""SELECT part AS split, source, count(*) AS n_rows FROM (SELECT lower({_sql_strip("split")}) AS part, {_sql_name("source")} AS source, prompt FROM bangla_safety_prompt_dataset)
WHERE part IN ('validation', 'test') AND NOT regexp_full_match(prompt, '[\p{{P}}{_BLANKS}]*') GROUP BY 1, 2""",
}
