"""Queries over rewards, gold fields and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reward
from .bindings import pairs
from .reports import SCORE_CTES, STRUCT_CTES, r9

_rows = lambda s, d: reward.rewards(pairs(s, d), "ord", "prediction", "reference")
_desc = "(description_finding_set_f1 + description_location_f1 + description_count_bucket_acc + description_cdr_tol_hit) / 4"


def _gold(s, d):
    g = reward.gold_fields(pairs(s, d).select("ord", "reference"), "reference")
    return g.select("ord", "gold_description", "gold_diagnosis_text", F.array_join("gold_diagnosis_labels", "、").alias("labels"), F.array_join("gold_findings", ";").alias("findings"), "gold_bucket_map_json", "gold_cdr_value")


def _messages(s, d):
    rows = s.read.parquet(f"{d}/benchmark.parquet").withColumn("m", reward.messages(F.col("text"), F.when(F.col("item_id") % 2 == 0, F.lit("yes"))))
    return rows.select("item_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), reward.content_text(F.to_variant_object(x["content"])))), "\n").alias("text"))


# Shapes of a turn as JSON: a text, an object, lists of both, a list in lists, blank parts, other values.
_T, _OBJ = "text", "to_json(named_struct('content', {0}))"
_PART = "named_struct('type', {0}, 'text', {1})"
_SHAPE = f"""CASE (conv_id + turn) % 8 WHEN 0 THEN substring(to_json(array(concat(' ', text, '\n'))), 2, length(to_json(array(concat(' ', text, '\n')))) - 2)
  WHEN 1 THEN {_OBJ.format("concat('  ', text)")}
  WHEN 2 THEN concat('[', {_OBJ.format(f"array({_PART.format("'text'", "text")}, {_PART.format("'image'", "'no'")}, {_PART.format("'text'", "'  '")})")}, ', " ", " tail "]')
  WHEN 3 THEN concat('[[["', role, ' "], ', {_OBJ.format("text")}, '], "end"]')
  WHEN 4 THEN concat('{{"content": [" a ", "", 5, ', to_json(array(text)), ', ', to_json({_PART.format("'text'", "text")}), ']}}')
  WHEN 5 THEN concat('{{"content": {{"text": ', CAST(turn AS STRING), '.5}}}}') WHEN 6 THEN '{{"role": "x"}}' ELSE CASE turn % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'true' ELSE '[]' END END"""


def _flattened(s, d):
    rows = s.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id", "turn", "role", "coalesce(text, '') AS text").selectExpr("conv_id", "turn", f"{_SHAPE} AS j")
    return rows.select("conv_id", "turn", reward.message_text(F.parse_json("j")).alias("text"))


QUERIES = {
    "rewards": lambda s, d: _rows(s, d).select("ord", *[r9(f"{m}_reward").alias(f"{m}_reward") for m in reward.REWARDS]),
    "reward_contributions": lambda s, d: reward.contributions(_rows(s, d), reward.reward_weights("all")).withColumns({c: r9(c) for c in ("weighted_contribution", "var")}),
    "gold_fields": _gold,
    "build_messages": _messages,
    "message_texts": _flattened,
}
_all = f"SELECT ord, format_correct AS f, {_desc} AS d, diagnosis_exact_set_acc AS g FROM scored"
_lines = lambda *parts: f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), chr(10))"
ORACLE_SQL = {
    "message_texts": f"""SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN {_lines("t", "'tail'")} WHEN 3 THEN {_lines("role", "t", "'end'")} WHEN 4 THEN {_lines("'a'", "t")}
  WHEN 5 THEN concat(turn, '.5') WHEN 6 THEN '' ELSE CASE turn % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'True' ELSE '' END END AS text
FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations)""",
    "rewards": f"WITH {SCORE_CTES} SELECT ord, round(f, 9) AS format_reward, round(d, 9) AS description_reward, round(g, 9) AS diagnosis_reward FROM ({_all})",
    "reward_contributions": f"WITH {SCORE_CTES}, a AS ({_all}) SELECT 'format' AS reward, round(avg(f) * 0.15::DOUBLE, 9) AS weighted_contribution, round(var_samp(f), 9) AS var FROM a UNION ALL SELECT 'description', round(avg(d) * 0.25::DOUBLE, 9), round(var_samp(d), 9) FROM a UNION ALL SELECT 'diagnosis', round(avg(g) * 0.6::DOUBLE, 9), round(var_samp(g), 9) FROM a",
    "gold_fields": f"""WITH {STRUCT_CTES} SELECT p.ord, p.description AS gold_description, trim(regexp_extract(s.norm, '(?m)^初步诊断\\s*:\\s*(.+)$', 1)) AS gold_diagnosis_text, array_to_string(p.labels, '、') AS labels, array_to_string(findings, ';') AS findings,
  concat('{{', array_to_string(list_transform(buckets, lambda x: concat('"', string_split(x, '=')[1], '": "', string_split(x, '=')[2], '"')), ', '), '}}') AS gold_bucket_map_json, ratio AS gold_cdr_value
FROM parsed p JOIN sections s ON s.ord = p.ord AND s.side = p.side WHERE p.side = 'r'""",
    "build_messages": "SELECT item_id, concat('user:', text, CASE WHEN item_id % 2 = 0 THEN chr(10) || 'assistant:yes' ELSE '' END) AS text FROM benchmark",
}
