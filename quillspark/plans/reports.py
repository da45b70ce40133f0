"""Queries over generated and predicted reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import sentences_of
from ..operators import metrics, parse, report, score
from .bindings import PARAMETER_SQL, pairs, parameter, quoted


def r9(c):
    return F.round(c, 9)


def _case(values: dict[str, str], of: str, default: str = "NULL") -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


def _mask_sql(prefix: str) -> str:
    bits = " + ".join(f"(CASE WHEN {prefix}{q} > 0 THEN {1 << k} ELSE 0 END)" for k, q in enumerate(dims.QUADRANTS))
    # Stated from the masks: which of the eight places a set of quadrants shows.
    shown = {1: "鼻下方", 2: "颞下方", 3: "下方", 4: "鼻上方", 5: "鼻侧", 6: "鼻上方、颞下方", 7: "下方、鼻上方", 8: "颞上方", 9: "鼻下方、颞上方", 10: "颞侧", 11: "下方、颞上方", 12: "上方", 13: "上方、鼻下方", 14: "上方、颞下方", 15: "上方、下方"}
    return f"CASE {bits} " + " ".join(f"WHEN {m} THEN '{v}'" for m, v in shown.items()) + " ELSE '' END"


def _report_sql() -> str:
    total = lambda p: "(" + " + ".join(p + q for q in dims.QUADRANTS) + ")"
    clause = {}
    for p, name, _, leveled, _ in dims.COUNTED:
        level = f"CASE WHEN {total(p)} < 5 THEN '散在' WHEN {total(p)} > 50 THEN '大量' ELSE '' END" if leveled else "''"
        clause[name] = f"CASE WHEN {total(p)} > 0 THEN concat({_mask_sql(p)}, '视网膜可见', {level}, '{name}。') END"
    free = "NOT list_has_any(tags, ['中央静脉阻塞', '分支静脉阻塞'])"
    macula = [f"CASE WHEN {p}r2 > 0 {'AND ' + free if name == '出血' else ''} THEN '黄斑处可见{name}。' END" for p, name, m, _, _ in dims.COUNTED if m]
    texts = {t: x for t, x in {**dims.DISEASE_TEXT, **dims.LESION_TEXT}.items() if x and t not in dims.DIAGNOSIS_ONLY_TAGS}
    section_of = lambda t: next((s for s, tags in dims.SECTION_TAGS.items() if t in tags), "other")

    def tagged(s: str) -> str:
        values = {t: x for t, x in texts.items() if section_of(t) == s}
        occluded = " WHEN t IN ('中央静脉阻塞', '分支静脉阻塞') THEN concat('静脉迂曲扩张，', places, '视网膜沿血管放射状出血。')" if s == "vessel" else ""
        return "list_transform(used, lambda t: CASE" + "".join(f" WHEN t = '{k}' THEN '{v}'" for k, v in values.items()) + occluded + " END)"

    fixed = {
        "disc": ["concat('杯盘比为0.', tenths, '。')", "CASE WHEN discbloodnumber > 0 THEN '视盘可见出血。' END", "CASE WHEN ratioatrophymaxwidth > 0 THEN '视盘旁可见脉络膜萎缩弧。' END"],
        "vessel": ["CASE WHEN arteriovenouscrossingnumber > 0 THEN concat('可见', arteriovenouscrossingnumber, '处动静脉交叉压迫点。') END", clause["静脉串珠"], clause["视网膜内微血管异常"], clause["新生血管"]],
        "macula": macula,
        "retina": [
            f"CASE WHEN {free} THEN {clause['出血']} END", *[clause[n] for n in ("玻璃膜疣", "硬性渗出", "纤维血管膜", "微血管瘤", "软性渗出")],
            "CASE WHEN atrophicfocinumber > 0 THEN '可见斑片状萎缩灶。' END", "CASE WHEN lacquercracknumber > 0 THEN '视网膜可见漆裂纹。' END",
            f"CASE WHEN {total(dims.LASER)} > 0 THEN '眼底可见激光斑。' END", "CASE WHEN rnfldarea > 0 THEN '可见神经纤维层缺损。' END",
        ],
    }
    lists = ", ".join(f"list_filter({'list_concat([' + ', '.join(fixed[s]) + '], ' + tagged(s) + ')' if s in fixed else tagged(s)}, lambda x: x IS NOT NULL) AS s_{s}" for s in dims.SECTIONS)
    once = " || ".join(f"array_to_string(list_filter(s_{s}, lambda x, i: list_position(s_{s}, x) = i), '')" for s in dims.SECTIONS)
    rank = "CASE t " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(dims.DIAGNOSIS_ORDER)) + " ELSE 1000 END"
    return f"""{PARAMETER_SQL}, alias AS (
  SELECT * REPLACE (list_transform(tags, lambda t: coalesce({_case(dims.TAG_ALIASES, 't')}, t)) AS tags), {_mask_sql('bloodnumberdistribution_')} AS places FROM b1
), used AS (
  SELECT *, list_filter(list_filter(tags, lambda x, i: list_position(tags, x) = i), lambda t: t NOT IN ({quoted(dims.IGNORED_TAGS)})) AS used FROM alias
), parts AS (SELECT ord, img_id, institution_name, img_path, used, {lists} FROM used
), diagnosed AS (
  SELECT ord, string_agg(t, '、' ORDER BY {rank}, i) AS diagnosis FROM (SELECT ord, unnest(used) AS t, generate_subscripts(used, 1) AS i FROM used) WHERE t IN ({quoted(dims.DISEASE_TEXT)}) GROUP BY ord
), reports AS (
  SELECT p.ord, img_id, concat('描述：', {once}, chr(10), '初步诊断：', coalesce(d.diagnosis, '未见明显异常表征')) AS description, institution_name, img_path
  FROM parts p LEFT JOIN diagnosed d ON d.ord = p.ord
)"""


REPORT_CTES = _report_sql()
PAIR_CTES = REPORT_CTES + """, cuts AS (
  SELECT ord, img_id, description AS reference, regexp_extract(description, '^描述：([^\\n]*)', 1) AS body, regexp_extract(description, '初步诊断：([^\\n]*)', 1) AS diagnosis,
    2 + ord % 8 + ord % 2 AS moved FROM reports
), b2 AS (
  SELECT ord, img_id, reference, CASE
    WHEN ord % 10 <= 4 THEN reference
    WHEN ord % 10 = 5 THEN concat('描述：', body, chr(10), '初步诊断：', regexp_replace(diagnosis, '^[^、]*、?', ''))
    WHEN ord % 10 = 6 THEN concat(reference, '、疑似青光眼')
    WHEN ord % 10 = 7 THEN replace(reference, concat('杯盘比为0.', 1 + ord % 8), concat('杯盘比为', moved // 10, '.', moved % 10))
    WHEN ord % 10 = 8 THEN concat('初步诊断：', diagnosis, chr(10), '描述：', body)
    ELSE '' END AS prediction
  FROM cuts
), sides AS (
  SELECT ord, img_id, 'p' AS side, translate(prediction, '：，。；（）', ':,.;()') AS norm FROM b2
  UNION ALL SELECT ord, img_id, 'r', translate(reference, '：，。；（）', ':,.;()') FROM b2
), sections AS (
  SELECT ord, img_id, side, norm, trim(regexp_extract(norm, '(?m)^描述\\s*:\\s*(.+)$', 1)) AS description, trim(regexp_extract(norm, '(?m)^初步诊断\\s*:\\s*(.+)$', 1)) AS diagnosis,
    len(list_filter(string_split(norm, chr(10)), lambda x: trim(x) <> '')) = 2 AND starts_with(norm, '描述:') AND contains(norm, chr(10) || '初步诊断:') AS good_format
  FROM sides
), labelled AS (
  SELECT *, list_sort(list_distinct(list_filter(list_transform(string_split(diagnosis, '、'), lambda x: trim(x)), lambda x: x <> ''))) AS labels FROM sections
), sentences AS (
  SELECT ord, side, pos, trim(replace(sentence, '@@', '.'), ' ,') AS sentence FROM (
    SELECT ord, side, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM (
      SELECT ord, side, string_split_regex(regexp_replace(description, '([0-9])\\.([0-9])', '\\1@@\\2', 'g'), '[.;]') AS parts FROM sections)
  ) WHERE trim(sentence, ' ,') <> ''
)"""
_c, _m, _o, _r = dims.COUNTED_PATTERN, dims.MACULA_PATTERN, dims.OCCLUSION_PATTERN, dims.RATIO_PATTERN
STRUCT_CTES = PAIR_CTES + f""", found AS (
  SELECT ord, side, pos, CASE
      WHEN regexp_matches(sentence, '{_r}') THEN NULL
      WHEN regexp_matches(sentence, '{_c}') THEN concat('视网膜:', regexp_extract(sentence, '{_c}', 3))
      WHEN regexp_matches(sentence, '{_m}') THEN concat('黄斑处:', regexp_extract(sentence, '{_m}', 1))
      WHEN regexp_matches(sentence, '{_o}') THEN '视网膜:沿血管放射状出血'
      WHEN regexp_matches(sentence, '^可见\\d+处动静脉交叉压迫点$') THEN '血管:动静脉交叉压迫点'
      ELSE {_case(dims.DIRECT_FINDINGS, 'sentence')} END AS finding,
    CASE WHEN regexp_matches(sentence, '{_c}') THEN regexp_extract(sentence, '{_c}', 1) WHEN regexp_matches(sentence, '{_o}') THEN regexp_extract(sentence, '{_o}', 1) ELSE '' END AS places,
    CASE WHEN regexp_matches(sentence, '{_c}') THEN concat('视网膜|', regexp_extract(sentence, '{_c}', 3), '|', coalesce(nullif(regexp_extract(sentence, '{_c}', 1), ''), '无位置')) END AS key,
    CASE WHEN regexp_matches(sentence, '{_c}') THEN coalesce(nullif(regexp_extract(sentence, '{_c}', 2), ''), 'default') END AS bucket,
    CAST(nullif(regexp_extract(sentence, '{_r}', 1), '') AS DOUBLE) AS ratio
  FROM sentences
), buckets AS (
  SELECT ord, side, key, arg_max(bucket, pos) AS bucket FROM found WHERE key IS NOT NULL GROUP BY ALL
), bucket_lists AS (SELECT ord, side, list(key || '=' || bucket ORDER BY key) AS buckets FROM buckets GROUP BY ALL
), lists AS (
  SELECT ord, side, list_sort(list_distinct(list(finding) FILTER (finding IS NOT NULL))) AS findings,
    list_sort(list_distinct(flatten(list(list_filter(string_split(places, '、'), lambda x: x <> ''))))) AS places, arg_max(ratio, pos) FILTER (ratio IS NOT NULL) AS ratio
  FROM found GROUP BY ALL
), parsed AS (
  SELECT l.ord, l.img_id, l.side, l.description, l.good_format, l.labels, coalesce(x.findings, []) AS findings, coalesce(x.places, []) AS places, coalesce(b.buckets, []) AS buckets, x.ratio
  FROM labelled l LEFT JOIN lists x ON x.ord = l.ord AND x.side = l.side LEFT JOIN bucket_lists b ON b.ord = l.ord AND b.side = l.side
)"""
_f1 = lambda c: f"CASE WHEN len(p.{c}) = 0 AND len(r.{c}) = 0 THEN 1.0 WHEN len(list_intersect(p.{c}, r.{c})) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(p.{c}, r.{c})) / (len(p.{c}) + len(r.{c})) END"
SCORE_CTES = STRUCT_CTES + f""", scored AS (
  SELECT p.ord, p.img_id, CAST(p.good_format AS INT)::DOUBLE AS format_correct, CAST(p.labels = r.labels AS INT)::DOUBLE AS diagnosis_exact_set_acc, CAST(p.description = r.description AS INT)::DOUBLE AS description_exact_match,
    CAST({_f1('findings')} AS DOUBLE) AS description_finding_set_f1, CAST({_f1('places')} AS DOUBLE) AS description_location_f1,
    CAST(CASE WHEN len(r.buckets) = 0 THEN CAST(len(p.buckets) = 0 AS INT) ELSE len(list_intersect(p.buckets, r.buckets))::DOUBLE / len(r.buckets) END AS DOUBLE) AS description_count_bucket_acc,
    CAST(CASE WHEN r.ratio IS NULL THEN 0 WHEN p.ratio IS NULL THEN 1 ELSE abs(p.ratio - r.ratio) END AS DOUBLE) AS description_cdr_abs_error,
    CAST(CASE WHEN r.ratio IS NULL THEN p.ratio IS NULL WHEN p.ratio IS NULL THEN false ELSE abs(p.ratio - r.ratio) <= 0.1::DOUBLE END AS INT)::DOUBLE AS description_cdr_tol_hit,
    p.labels AS pred_labels, r.labels AS ref_labels
  FROM parsed p JOIN parsed r ON r.ord = p.ord WHERE p.side = 'p' AND r.side = 'r'
), each_label AS (
  SELECT label, count(*) FILTER (in_p AND in_r) AS tp, count(*) FILTER (in_p AND NOT in_r) AS fp, count(*) FILTER (NOT in_p AND in_r) AS fn FROM (
    SELECT label, list_contains(pred_labels, label) AS in_p, list_contains(ref_labels, label) AS in_r FROM (SELECT unnest(list_distinct(list_concat(pred_labels, ref_labels))) AS label, pred_labels, ref_labels FROM scored)
  ) GROUP BY label
), rated AS (
  SELECT label, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
    CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1, (SELECT count(*) FROM scored) AS n FROM each_label
)"""
M = score.MEASURES


def _side(spark, d):
    return parse.parsed(pairs(spark, d), "prediction", "p_")


def scored(spark, d):
    return score.score_reports(pairs(spark, d))


QUERIES = {
    "report_text": lambda s, d: report.report_text(parameter(s, d)),
    "section_parse": lambda s, d: _side(s, d).select("ord", F.col("p_description").alias("description"), F.array_join("p_labels", "、").alias("labels"), F.col("p_format").alias("good_format")),
    "sentence_split": lambda s, d: _side(s, d).select("ord", F.posexplode(sentences_of(F.col("p_description"))).alias("pos", "sentence")).select("ord", (F.col("pos") + 1).cast("long").alias("pos"), "sentence"),
    "finding_struct": lambda s, d: _side(s, d).select("ord", F.array_join("p_findings", ";").alias("findings"), F.array_join("p_places", ";").alias("places"), F.array_join(F.transform("p_buckets", lambda x: F.concat(x["key"], F.lit("="), x["bucket"])), ";").alias("buckets"), F.col("p_ratio").alias("ratio")),
    "score_rows": lambda s, d: score.flat_rows(scored(s, d), "ord").withColumns({m: r9(m) for m in M}),
    "score_mean": lambda s, d: metrics.mean_scores(scored(s, d)).select(*[r9(m).alias(m) for m in M], "num_samples"),
    "weighted_mean": lambda s, d: metrics.mean_scores(score.weighted_scores(scored(s, d)), ("description_score", "format_score", "diagnosis_score", "final_score")).select(*[r9(m).alias(m) for m in ("description_score", "format_score", "diagnosis_score", "final_score")], "num_samples"),
    "label_counts": lambda s, d: metrics.label_metrics(scored(s, d)).withColumns({c: r9(c) for c in ("precision", "recall", "f1", "accuracy")}),
    "micro_macro_f1": lambda s, d: metrics.micro_macro(scored(s, d)).select(*[r9(c).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "macro_f1")]),
    "family_accuracy": lambda s, d: metrics.family_accuracy(scored(s, d)).withColumn("accuracy", r9("accuracy")),
    "family_mean": lambda s, d: metrics.family_mean(metrics.family_accuracy(scored(s, d))).select(r9("family_level_accuracy").alias("family_level_accuracy")),
}
_families = " UNION ALL ".join(f"SELECT '{f}' AS family, [{quoted(m)}] AS members" for f, m in dims.FAMILIES.items())
_family_sql = SCORE_CTES + f""", families AS ({_families}), cut AS (
  SELECT family, list_sort(list_intersect(ref_labels, members)) AS r, list_sort(list_intersect(pred_labels, members)) AS p FROM scored CROSS JOIN families
), by_family AS (
  SELECT family, count(*) FILTER (len(r) > 0) AS support, count(*) FILTER (len(r) > 0 AND r = p) AS correct FROM cut GROUP BY family
), accurate AS (SELECT family, support, correct, round(CASE WHEN support = 0 THEN 0 ELSE correct::DOUBLE / support END, 9) AS accuracy FROM by_family)"""
_rounded = lambda cs, how="{}": ", ".join(f"round({how.format(c)}, 9) AS {c}" for c in cs)
_parts = "(description_finding_set_f1 + description_location_f1 + description_count_bucket_acc + description_cdr_tol_hit) / 4"
ORACLE_SQL = {
    "report_text": f"WITH {REPORT_CTES} SELECT img_id, description, institution_name, img_path FROM reports",
    "section_parse": f"WITH {PAIR_CTES} SELECT ord, description, array_to_string(labels, '、') AS labels, good_format FROM labelled WHERE side = 'p'",
    "sentence_split": f"WITH {PAIR_CTES} SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY pos) AS pos, sentence FROM sentences WHERE side = 'p'",
    "finding_struct": f"WITH {STRUCT_CTES} SELECT ord, array_to_string(findings, ';') AS findings, array_to_string(places, ';') AS places, array_to_string(buckets, ';') AS buckets, ratio FROM parsed WHERE side = 'p'",
    "score_rows": f"WITH {SCORE_CTES} SELECT ord, {_rounded(M)}, array_to_string(pred_labels, '、') AS pred_diagnosis_labels, array_to_string(ref_labels, '、') AS ref_diagnosis_labels FROM scored",
    "score_mean": f"WITH {SCORE_CTES} SELECT {_rounded(M, 'avg({})')}, count(*) AS num_samples FROM scored",
    "weighted_mean": f"WITH {SCORE_CTES} SELECT round(avg({_parts}), 9) AS description_score, round(avg(format_correct), 9) AS format_score, round(avg(diagnosis_exact_set_acc), 9) AS diagnosis_score, round(avg(0.25::DOUBLE * {_parts} + 0.15::DOUBLE * format_correct + 0.6::DOUBLE * diagnosis_exact_set_acc), 9) AS final_score, count(*) AS num_samples FROM scored",
    "label_counts": f"WITH {SCORE_CTES} SELECT label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round((n - fp - fn)::DOUBLE / n, 9) AS accuracy, tp + fn AS support FROM rated",
    "micro_macro_f1": f"WITH {SCORE_CTES} SELECT round(sum(tp)::DOUBLE / sum(tp + fp), 9) AS micro_precision, round(sum(tp)::DOUBLE / sum(tp + fn), 9) AS micro_recall, round(2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn), 9) AS micro_f1, round(avg(f1), 9) AS macro_f1 FROM rated",
    "family_accuracy": f"WITH {_family_sql} SELECT * FROM accurate",
    "family_mean": f"WITH {_family_sql} SELECT round(avg(correct::DOUBLE / support), 9) AS family_level_accuracy FROM accurate WHERE support > 0",
}
