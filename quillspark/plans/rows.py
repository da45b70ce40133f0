"""Queries over single-row operators: identifiers, sizes, metric names, text forms, loss terms and row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims, text, udf
from ..operators import gold, numeric, rank, reward, split, tail
from ..session import work_path, written
from .bindings import LABELS, pairs, quoted
from .reports import SCORE_CTES, r9

N = len(LABELS)
_LABEL = f"element_at(array({quoted(LABELS)}), CAST(p_partkey % {N} + 1 AS int))"
_LABEL_SQL = f"list_extract([{quoted(LABELS)}], p_partkey % {N} + 1)"
_SIDES = "CASE p_partkey % 7 WHEN 0 THEN 'OS' WHEN 1 THEN ' od ' WHEN 2 THEN 'Left' WHEN 3 THEN '右眼' WHEN 4 THEN 'Other' WHEN 5 THEN '' END"
_METRICS = ("eval_loss", "eval_diag_bce_loss", "eval_description_cdr_mae", "eval_diagnosis_micro_f1", "eval_runtime", "loss")
_METRIC = f"CASE p_partkey % 6 {' '.join(f'''WHEN {k} THEN '{m}' ''' for k, m in enumerate(_METRICS))} END"
_RECORD = "concat(CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '_x_OD.jpg' WHEN 1 THEN '_y_z_os.png' WHEN 2 THEN '_OD.jpg' ELSE '_a_mid.jpg' END)"


def part(s, d, *exprs):
    return s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", *exprs)


def _identifiers(s, d):
    rows = part(s, d, "concat(CASE p_partkey % 3 WHEN 0 THEN ' ' ELSE '' END, CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.0' WHEN 1 THEN '.000 ' WHEN 2 THEN '.50' ELSE '' END) AS i", f"{_SIDES} AS e", "concat(' P_', p_type, '-(', p_name, ')') AS c")
    return rows.select("p_partkey", text.identifier(F.col("i")).alias("identifier"), text.eye_side(F.col("e")).alias("side"), text.column_key(F.col("c")).alias("key"))


def _records(s, d):
    return part(s, d, f"{_RECORD} AS n").withColumn("r", text.record_of(F.col("n"))).select("p_partkey", "r.record", "r.side")


def _metrics(s, d):
    rows = part(s, d, f"{_METRIC} AS m", "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS w")
    return rows.select("p_partkey", rank.greater_is_better(F.col("m")).alias("greater"), rank.structured_metric(F.col("m")).alias("structured"), rank.runs_structured(F.col("m"), F.col("w")).alias("runs"))


def _boxes(s, d):
    rows = part(s, d, "p_partkey % 3000 + 1 AS w", "p_partkey * 7 % 2000 + 1 AS h")
    box = numeric.padded_box(F.col("w"), F.col("h"), 1024, 768)
    return rows.select("p_partkey", *[c.cast("long").alias(k) for k, c in box.items()])


def _crops(s, d):
    rows = part(s, d, "p_partkey % 900 + 100 AS w", "p_partkey * 7 % 700 + 100 AS h", "CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 50 END AS x1", "50 + p_partkey % 49 AS x2", "p_partkey % 20 AS y1", "20 + p_partkey % 79 AS y2")
    return rows.select("p_partkey", *[c.alias(k) for k, c in numeric.crop_box(F.col("w"), F.col("h"), (F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"))).items()])


def _forms(s, d):
    rows = part(s, d, "concat('描述：Ａ', translate(CAST(p_partkey AS STRING), '0123456789', '０１２３４５６７８９'), '㎜ \r\n\n ；ok') AS t", "CAST(p_retailprice AS double) / 7 AS v", "concat('[\\'', p_brand, '\\', 3, \"', p_type, '\"]') AS l", "CASE p_partkey % 4 WHEN 0 THEN '(1, 2)' WHEN 1 THEN 'plain text' WHEN 2 THEN 'nan' END AS o")
    return rows.select("p_partkey", udf.nfkc_normalized("t").alias("normal"), udf.fixed(6)("v").alias("six"), udf.fixed(0)("v").alias("whole"), F.array_join(udf.literal_list("l"), "|").alias("items"), F.array_join(udf.literal_list("o"), "|").alias("others"))


def _invalid(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return rows, F.when(F.col("doc_id") % 11 == 0, F.lit("FileNotFoundError: no image")).when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, F.lit("ValueError: empty"))


def _zipped(s, d):
    rows = s.read.parquet(f"{d}/customer.parquet")
    return split.zipped(rows.select("c_custkey", "c_name"), rows.select("c_custkey", (F.col("c_custkey") % 2).alias("pred_label"), F.round(F.col("c_acctbal").cast("double"), 6).alias("prob")), "c_custkey")


def _gold(s, d):
    rows = written(pairs(s, d), "pairs")
    stored = gold.StoredGold(s, work_path(s, "gold"), "ord")
    stored.write(rows.select("ord", "reference"), "reference")
    names = ("format_correct", "diagnosis_exact_set_acc", "description_exact_match", "description_finding_set_f1", "description_location_f1", "description_count_bucket_acc", "description_cdr_tol_hit")
    return stored.scored(rows.select("ord", "prediction"), "prediction").select("ord", *[r9(n).alias(n) for n in names])


def _buckets(s, d):
    found = reward.gold_fields(pairs(s, d).select("ord", "reference"), "reference")
    entries = F.array_sort(F.map_entries(reward.decoded_buckets(F.col("gold_bucket_map_json"))))
    return found.select("ord", F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("buckets"))


def _base(s, d):
    rows = part(s, d, "CAST(p_partkey AS STRING) AS img_id", "p_name AS image_path", "p_type AS answer", "p_brand AS institution_name", "p_type AS diagnosis", "'weak' AS aug_level", "(p_partkey % 100) / 300.0D AS tail_score")
    return tail.base_rows(rows, lambda c: udf.fixed(6)(c))


def _evaluation(s, d):
    rows = s.read.parquet(f"{d}/benchmark.parquet").selectExpr("item_id", "text AS prompt_text", "concat('gold ', item_id) AS ground_truth")
    return reward.evaluation_rows(rows)


QUERIES = {
    "identifiers": _identifiers,
    "record_names": _records,
    "metric_kinds": _metrics,
    "scalar_metrics": lambda s, d: rank.scalar_metrics(part(s, d, "p_size", "p_name", "CAST(p_retailprice AS double) AS price", "p_size > 25 AS large", "CASE WHEN p_size < 5 THEN 1.5D END AS rare"), "p_partkey", "eval"),
    "evaluated_rows": lambda s, d: rank.evaluated_rows(part(s, d), "p_partkey", 100),
    "save_steps": lambda s, d: part(s, d, "p_partkey * 10 AS a", "p_size * 5 AS b").select("p_partkey", rank.aligned_save_steps(F.col("a"), F.col("b")).alias("steps")),
    "padded_size": _boxes,
    "crop_box": _crops,
    "text_forms": _forms,
    "diagnosis_part": lambda s, d: pairs(s, d).select("ord", text.diagnosis_part(F.col("prediction")).alias("diagnosis")),
    # Halves of tenths and numbers near them, of both signs.
    "ratio_text": lambda s, d: part(s, d, "(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END) * (CASE p_partkey % 4 WHEN 0 THEN p_partkey / 20.0D WHEN 1 THEN p_partkey / 100.0D WHEN 2 THEN p_partkey / 8.0D ELSE p_partkey * 1e9D / 7 END) AS v").select("p_partkey", text.one_decimal(F.col("v")).alias("t")),
    "selected_images": lambda s, d: split.kept_and_removed(part(s, d, "concat(' ', CAST(p_partkey AS STRING)) AS img_id"), s.read.parquet(f"{d}/lineitem.parquet").selectExpr("CASE WHEN l_quantity < 5 THEN '' ELSE CAST(l_partkey AS STRING) END AS k").where("k <> '7'"), "img_id", "k")[0].select("p_partkey"),
    "durations": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", text.duration(F.col("value") * 100).alias("t")),
    "rerooted_paths": lambda s, d: part(s, d, "concat(CASE p_partkey % 4 WHEN 0 THEN '/old/data_root/a/' WHEN 1 THEN '/else/' WHEN 2 THEN 'rel/' ELSE '/x/data_root/data_root/' END, CAST(p_partkey AS STRING)) AS p").select("p_partkey", reward.rerooted(F.col("p"), "data_root", "/new/").alias("path")),
    "valid_rows": lambda s, d: split.valid_and_invalid(*_invalid(s, d))[0].select("doc_id"),
    "invalid_rows": lambda s, d: split.numbered_errors(*_invalid(s, d), "doc_id"),
    "contrast_eligible": lambda s, d: part(s, d, f"array({_LABEL}, 'x') AS l").select("p_partkey", split.contrast_eligible(F.col("l")).alias("eligible")),
    "has_places": lambda s, d: pairs(s, d).select("ord", text.has_place(F.regexp_extract("reference", "^描述：([^\n]*)", 1)).alias("placed")),
    "zipped_predictions": _zipped,
    "gold_scores": _gold,
    "gold_buckets": _buckets,
    "base_rows": _base,
    "evaluation_rows": _evaluation,
    "multi_hot": lambda s, d: part(s, d, f"array({_LABEL}, 'x') AS l").select("p_partkey", F.array_join(numeric.multi_hot(F.col("l"), F.array(*map(F.lit, LABELS))).cast("array<int>"), "").alias("hot")),
    "multitask_loss": lambda s, d: part(s, d, "p_size / 7.0D AS a", "p_partkey % 10 / 3.0D AS b").select("p_partkey", r9(numeric.multitask_loss(F.col("a"), F.col("b"), 0.3)).alias("loss")),
}
_scores = "round(format_correct, 9) AS format_correct, round(diagnosis_exact_set_acc, 9) AS diagnosis_exact_set_acc, round(description_exact_match, 9) AS description_exact_match, round(description_finding_set_f1, 9) AS description_finding_set_f1, round(description_location_f1, 9) AS description_location_f1, round(description_count_bucket_acc, 9) AS description_count_bucket_acc, round(description_cdr_tol_hit, 9) AS description_cdr_tol_hit"
_contrast = f"[{quoted(dims.CONTRAST_TAGS)}]"
_box = "SELECT p_partkey, p_partkey % 3000 + 1 AS w, p_partkey * 7 % 2000 + 1 AS h FROM part"
ORACLE_SQL = {
    "identifiers": """SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN concat(p_partkey, '.50') ELSE CAST(p_partkey AS VARCHAR) END AS identifier,
  CASE p_partkey % 7 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'left' WHEN 3 THEN 'right' WHEN 4 THEN 'other' ELSE '' END AS side, regexp_replace(lower(concat('p', p_type, p_name)), '[^a-z0-9]', '', 'g') AS key FROM part""",
    "record_names": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_partkey AS VARCHAR) END AS record, CASE p_partkey % 4 WHEN 0 THEN 'right' WHEN 1 THEN 'left' END AS side FROM part",
    "metric_kinds": "SELECT p_partkey, p_partkey % 6 > 2 AS greater, p_partkey % 6 IN (2, 3) AS structured, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE p_partkey % 6 IN (2, 3) END AS runs FROM part",
    "scalar_metrics": """SELECT p_partkey, 'eval_p_size' AS metric, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'eval_price', p_retailprice::DOUBLE FROM part
  UNION ALL SELECT p_partkey, 'eval_large', (p_size > 25)::INT::DOUBLE FROM part UNION ALL SELECT p_partkey, 'eval_rare', 1.5 FROM part WHERE p_size < 5""",
    "evaluated_rows": "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 100",
    "save_steps": "SELECT p_partkey, CAST(ceil(p_partkey * 10 / (p_size * 5)::DOUBLE) * p_size * 5 AS BIGINT) AS steps FROM part",
    "padded_size": f"""WITH p AS ({_box}), q AS (SELECT *, least(1024::DOUBLE / w, 768::DOUBLE / h) AS f FROM p),
r AS (SELECT p_partkey, greatest(CAST(round_even(w * f, 0) AS BIGINT), 1) AS width, greatest(CAST(round_even(h * f, 0) AS BIGINT), 1) AS height FROM q)
SELECT *, CAST(floor((1024 - width) / 2) AS BIGINT) AS "left", CAST(floor((768 - height) / 2) AS BIGINT) AS top FROM r""",
    "crop_box": """WITH p AS (SELECT p_partkey, p_partkey % 900 + 100 AS w, p_partkey * 7 % 700 + 100 AS h, p_partkey % 50 AS x1, 50 + p_partkey % 49 AS x2, p_partkey % 20 AS y1, 20 + p_partkey % 79 AS y2, p_partkey % 9 = 0 AS none FROM part),
q AS (SELECT *, greatest(x2 - x1, y2 - y1) + 1 AS side, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy FROM p), r AS (SELECT *, (side + 2 * CAST(floor(side * 0.02::DOUBLE) AS BIGINT)) // 2 AS half FROM q)
SELECT p_partkey, CASE WHEN none THEN 0 ELSE greatest(0, cx - half) END AS "left", CASE WHEN none THEN w ELSE least(w, cx + half) END AS "right", CASE WHEN none THEN 0 ELSE greatest(0, cy - half) END AS top, CASE WHEN none THEN h ELSE least(h, cy + half) END AS bottom FROM r""",
    "text_forms": """SELECT p_partkey, concat('描述:A', p_partkey, 'mm', chr(10), ';ok') AS normal, printf('%.6f', p_retailprice::DOUBLE / 7) AS six, printf('%.0f', p_retailprice::DOUBLE / 7) AS whole, concat(p_brand, '|3|', p_type) AS items,
  CASE p_partkey % 4 WHEN 0 THEN '1|2' WHEN 1 THEN 'plain text' ELSE '' END AS others FROM part""",
    "diagnosis_part": f"WITH {SCORE_CTES} SELECT ord, CASE WHEN t = '' THEN 'UNKNOWN' ELSE t END AS diagnosis FROM (SELECT ord, trim(regexp_extract(prediction, '初步诊断[：:]\\s*([^\\n]+)', 1)) AS t FROM b2)",
    "ratio_text": "SELECT p_partkey, printf('%.1f', (CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END) * (CASE p_partkey % 4 WHEN 0 THEN p_partkey / 20.0::DOUBLE WHEN 1 THEN p_partkey / 100.0::DOUBLE WHEN 2 THEN p_partkey / 8.0::DOUBLE ELSE p_partkey * 1e9::DOUBLE / 7 END) + 0.0::DOUBLE) AS t FROM part",
    "selected_images": "SELECT p_partkey FROM part WHERE p_partkey <> 7 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 5)",
    "durations": "SELECT event_id, CASE WHEN s < 0 THEN '00:00:00' ELSE printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS t FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s FROM events)",
    "rerooted_paths": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('/new/data_root/a/', p_partkey) WHEN 1 THEN concat('/else/', p_partkey) WHEN 2 THEN concat('/new/data_root/rel/', p_partkey) ELSE concat('/new/data_root/data_root/', p_partkey) END AS path FROM part",
    "valid_rows": "SELECT doc_id FROM documents WHERE doc_id % 11 <> 0 AND trim(coalesce(text, '')) <> ''",
    "invalid_rows": "SELECT row_number() OVER (ORDER BY doc_id) + 1 AS row_number, * FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'FileNotFoundError: no image' WHEN trim(coalesce(text, '')) = '' THEN 'ValueError: empty' END AS error FROM documents) QUALIFY error IS NOT NULL",
    "contrast_eligible": f"SELECT p_partkey, list_contains({_contrast}, {_LABEL_SQL}) AS eligible FROM part",
    "has_places": f"WITH {SCORE_CTES} SELECT ord, regexp_matches(regexp_extract(reference, '^描述：([^\\n]*)', 1), '鼻下方|鼻上方|颞下方|颞上方|下方|上方|鼻侧|颞侧') AS placed FROM b2",
    "zipped_predictions": "SELECT c_custkey, c_name, c_custkey % 2 AS pred_label, round(c_acctbal::DOUBLE, 6) AS prob FROM customer",
    "gold_scores": f"WITH {SCORE_CTES} SELECT ord, {_scores} FROM scored",
    "gold_buckets": f"WITH {SCORE_CTES} SELECT ord, array_to_string(buckets, ';') AS buckets FROM parsed WHERE side = 'r'",
    "base_rows": "SELECT CAST(p_partkey AS VARCHAR) AS img_id, p_name AS image_path, p_type AS answer, p_brand AS institution_name, p_type AS diagnosis, '0' AS is_augmented, 'weak' AS aug_level, printf('%.6f', (p_partkey % 100) / 300.0::DOUBLE) AS tail_score, '' AS aug_ops, CAST(p_partkey AS VARCHAR) AS source_img_id FROM part",
    "evaluation_rows": "SELECT item_id, text AS prompt, concat('gold ', item_id) AS answer FROM benchmark",
    "multi_hot": f"SELECT p_partkey, array_to_string(list_transform([{quoted(LABELS)}], lambda x: (x = {_LABEL_SQL})::INT), '') AS hot FROM part",
    "multitask_loss": "SELECT p_partkey, round(p_size / 7.0::DOUBLE + 0.3::DOUBLE * (p_partkey % 10 / 3.0::DOUBLE), 9) AS loss FROM part",
}
