"""Queries over keyed tables, annotations and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import in_diagnosis_order, report_hash
from ..operators import sync
from .bindings import LABELS, quoted

_ARRAY = f"array({quoted(LABELS)})"
_LIST = f"[{quoted(LABELS)}]"
N = len(LABELS)


def diseases(s, d):
    """B5: a disease row a line: image (two a part of an order), side and label."""
    rows = s.read.parquet(f"{d}/lineitem.parquet")
    return rows.selectExpr(
        "(l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey AS ord", "CAST(l_orderkey AS string) AS img_id", "CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'R' THEN 'Right ' ELSE ' ' END AS eye_side",
        f"element_at({_ARRAY}, CAST(l_partkey % {N} + 1 AS int)) AS tag", "CAST(l_suppkey AS string) AS patient_record_id",
    )


def _sheet(s, d):
    """B5 as a spreadsheet has it: other headers, ids as numbers, sides in several spellings and blank."""
    return diseases(s, d).selectExpr(
        "ord", "CASE WHEN ord % 2 = 0 THEN concat(img_id, '.0') ELSE concat(' ', img_id) END AS `Image ID`", "concat(patient_record_id, '.00') AS `Patient-Record.ID`",
        "CASE trim(eye_side) WHEN 'left' THEN 'OS ' WHEN 'Right' THEN CASE WHEN ord % 3 = 0 THEN '右眼' ELSE 'Right ' END ELSE eye_side END AS Eye_Side",
    )


_SHEET_SQL = "r AS (SELECT CAST(l_suppkey AS VARCHAR) AS patient_record_id, CASE l_returnflag WHEN 'A' THEN 'left' ELSE 'right' END AS eye_side, CAST(l_orderkey AS VARCHAR) AS img_id, (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey AS ord FROM lineitem WHERE l_returnflag IN ('A', 'R'))"
DISEASE_SQL = f"""dis AS (
  SELECT ord, img_id, side, patient_record_id, CASE WHEN tag = '糖尿病视网膜病变增殖期' THEN '糖尿病视网膜病变增生期' ELSE tag END AS tag FROM (
    SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey AS ord, CAST(l_orderkey AS VARCHAR) AS img_id, CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'R' THEN 'right' ELSE '' END AS side,
      list_extract({_LIST}, l_partkey % {N} + 1) AS tag, CAST(l_suppkey AS VARCHAR) AS patient_record_id FROM lineitem)
), sides AS (SELECT img_id, coalesce(arg_min(side, ord) FILTER (side <> ''), '') AS eye_side FROM dis GROUP BY img_id
), firsts AS (SELECT img_id, tag, min(ord) AS ord FROM dis GROUP BY ALL
), own AS (SELECT img_id, list(tag ORDER BY ord) AS tags FROM firsts GROUP BY img_id)"""


def patients(s, d):
    rows = s.read.parquet(f"{d}/orders.parquet")
    item = f"concat(element_at({_ARRAY}, CAST(o_custkey % {N} + 1 AS int)), '，', element_at(array('左眼', '右眼', '双眼', '不明'), CAST(o_orderkey % 4 + 1 AS int)))"
    return rows.selectExpr("o_orderkey AS ord", "o_orderpriority AS institution_name", "array(CAST(o_orderkey AS string), CAST(o_orderkey + 1 AS string)) AS ids", f"array('未见明显异常', {item}) AS abnormal")


def images(s, d):
    """An annotated image an order, with twice its key, so that images with odd keys have none."""
    rows = s.read.parquet(f"{d}/orders.parquet")
    return rows.selectExpr(
        "o_orderkey AS ord", "concat('r', o_custkey, '_x_', CASE WHEN o_orderkey % 2 = 0 THEN 'OD' ELSE 'OS' END, '_', o_orderkey * 2, '.jpg') AS name",
        "CASE WHEN o_orderstatus = 'P' THEN '模糊图' WHEN o_orderkey % 5 = 0 THEN '4' ELSE '' END AS free_text",
        f"""concat('None"', element_at({_ARRAY}, CAST(o_custkey % {N} + 1 AS int)), '", , "视盘水肿", "视盘水肿",') AS label_text""",
    )


def _labels(s, d):
    return sync.patient_labels(patients(s, d), F.col("ids"), F.col("abnormal"), sync.image_sides_and_labels(diseases(s, d), F.array("tag")))


def _synced(s, d):
    parameter = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("img_id"))
    return sync.synced(parameter, _labels(s, d), sync.annotations(images(s, d)))


SYNC_SQL = DISEASE_SQL + f""", pat AS (
  SELECT o_orderkey + j AS img, o_orderkey AS ord, j, o_orderpriority AS institution_name, CASE WHEN list_extract({_LIST}, o_custkey % {N} + 1) = '糖尿病视网膜病变增殖期' THEN '糖尿病视网膜病变增生期' ELSE list_extract({_LIST}, o_custkey % {N} + 1) END AS tag, o_orderkey % 4 AS kind
  FROM orders, (SELECT unnest([0, 1]) AS j)
), last AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY ord DESC, j DESC) AS r FROM pat
), sided AS (
  SELECT CAST(img AS VARCHAR) AS img_id, institution_name, CASE WHEN kind = 2 OR (kind = 0 AND s.eye_side = 'left') OR (kind = 1 AND s.eye_side = 'right') THEN [tag] ELSE [] END AS side_tags, coalesce(o.tags, []) AS own
  FROM last LEFT JOIN sides s ON s.img_id = CAST(img AS VARCHAR) LEFT JOIN own o ON o.img_id = CAST(img AS VARCHAR) WHERE r = 1
), plab AS (SELECT img_id, institution_name, list_concat(side_tags, list_filter(own, lambda x: NOT list_contains(side_tags, x))) AS tags FROM sided
), ann AS (
  SELECT CAST(o_orderkey * 2 AS VARCHAR) AS img_id, o_orderstatus = 'P' OR o_orderkey % 5 = 0 AS bad,
    CASE WHEN t = '视盘水肿' THEN ['视盘水肿'] WHEN t = '糖尿病视网膜病变增殖期' THEN ['糖尿病视网膜病变增生期', '视盘水肿'] ELSE [t, '视盘水肿'] END AS tags
  FROM (SELECT *, list_extract({_LIST}, o_custkey % {N} + 1) AS t FROM orders)
)"""

def _subset(s, d):
    """Entries of the first 4000 annotated images, whose records are suppliers' or nobody's, against the sheet's look-up and an order a parameter row."""
    rows = images(s, d).withColumn("name", F.expr("concat(CASE WHEN ord % 9 = 0 THEN 'none' ELSE CAST(ord % 130 AS STRING) END, '_x_', CASE ord % 5 WHEN 0 THEN 'OD' WHEN 4 THEN 'XX' ELSE 'os' END, '.jpg')"))
    rows = rows.withColumn("free_text", F.expr("CASE WHEN ord % 97 = 0 THEN '4' WHEN ord % 89 = 0 THEN '有模糊' ELSE '' END"))
    entries = sync.subset_entries(rows, 4000)[0]
    parameter = s.read.parquet(f"{d}/orders.parquet").selectExpr("concat(' ', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END) AS img_id", "o_orderstatus AS status", "array('old') AS tags")
    return sync.subset_parameter(entries, sync.composite_lookup(_sheet(s, d))[0], parameter)


QUERIES = {
    "subset_parameter": lambda s, d: _subset(s, d)[0].select("img_id", "status", F.array_join("tags", "、").alias("tags")),
    "subset_unmatched": lambda s, d: _subset(s, d)[1],
    "subset_excluded": lambda s, d: _subset(s, d)[2],
    "image_sides": lambda s, d: sync.image_sides(diseases(s, d)),
    "image_labels": lambda s, d: sync.image_labels(diseases(s, d), F.array("tag")).select("img_id", F.array_join("tags", "、").alias("tags")),
    "patient_labels": lambda s, d: _labels(s, d).select("img_id", F.array_join("tags", "、").alias("tags"), "institution_name"),
    "annotation_labels": lambda s, d: sync.annotations(images(s, d)).select("img_id", F.array_join("tags", "、").alias("tags"), "excluded"),
    "tag_sync": lambda s, d: _synced(s, d).select("img_id", F.array_join("tags", "、").alias("tags"), F.array_join(in_diagnosis_order(F.col("tags")), "、").alias("ordered"), "institution_name", "img_path"),
    "composite_lookup": lambda s, d: sync.composite_lookup(_sheet(s, d))[0],
    "lookup_conflicts": lambda s, d: sync.composite_lookup(_sheet(s, d))[1],
    "report_hash": lambda s, d: s.read.parquet(f"{d}/benchmark.parquet").select("item_id", report_hash(F.concat(F.lit(" "), "text", F.lit("\r\n"))).alias("hash")),
}
_rank = "CASE t " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(LABELS[:26])) + " ELSE 1000 + i END"
_SUBSET_SQL = f"""WITH {_SHEET_SQL}, look AS (SELECT patient_record_id, eye_side, arg_min(img_id, ord) AS img_id FROM r GROUP BY patient_record_id, eye_side),
ent AS (SELECT o_orderkey AS ord, concat(CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE CAST(o_orderkey % 130 AS VARCHAR) END, '_x_', CASE o_orderkey % 5 WHEN 0 THEN 'OD' ELSE 'os' END, '.jpg') AS name,
    CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE CAST(o_orderkey % 130 AS VARCHAR) END AS rec, CASE WHEN o_orderkey % 5 = 0 THEN 'right' ELSE 'left' END AS side, o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 AS bad,
    list_extract({_LIST}, o_custkey % {N} + 1) AS t FROM orders WHERE o_orderkey <= 4000 AND o_orderkey % 5 <> 4),
met AS (SELECT e.*, l.img_id FROM ent e LEFT JOIN look l ON l.patient_record_id = rec AND l.eye_side = side),
img AS (SELECT img_id, arg_max(t, ord) AS t, bool_or(bad) AS bad FROM met WHERE img_id IS NOT NULL GROUP BY img_id)"""
ORACLE_SQL = {
    "subset_parameter": f"""{_SUBSET_SQL} SELECT img_id, o_orderstatus AS status, CASE WHEN t = '视盘水肿' THEN t WHEN t = '糖尿病视网膜病变增殖期' THEN '糖尿病视网膜病变增生期、视盘水肿' ELSE concat(t, '、视盘水肿') END AS tags
FROM img JOIN orders ON CAST(o_orderkey AS VARCHAR) = img_id WHERE NOT bad""",
    "subset_unmatched": f"{_SUBSET_SQL} SELECT ord, name FROM met WHERE img_id IS NULL",
    "subset_excluded": f"{_SUBSET_SQL} SELECT img_id FROM img WHERE bad",
    "image_sides": f"WITH {DISEASE_SQL} SELECT * FROM sides",
    "image_labels": f"WITH {DISEASE_SQL} SELECT img_id, array_to_string(tags, '、') AS tags FROM own",
    "patient_labels": f"WITH {SYNC_SQL} SELECT img_id, array_to_string(tags, '、') AS tags, institution_name FROM plab",
    "annotation_labels": f"WITH {SYNC_SQL} SELECT img_id, array_to_string(tags, '、') AS tags, bad AS excluded FROM ann",
    "tag_sync": f"""WITH {SYNC_SQL}, j AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS img_id, CASE WHEN a.img_id IS NOT NULL THEN a.tags ELSE coalesce(p.tags, []) END AS tags, p.institution_name
  FROM orders o LEFT JOIN plab p ON p.img_id = CAST(o_orderkey AS VARCHAR) LEFT JOIN ann a ON a.img_id = CAST(o_orderkey AS VARCHAR) WHERE a.img_id IS NULL OR NOT a.bad
), ord AS (SELECT img_id, string_agg(t, '、' ORDER BY {_rank}) AS ordered FROM (SELECT img_id, unnest(tags) AS t, generate_subscripts(tags, 1) AS i FROM j) GROUP BY img_id)
SELECT j.img_id, array_to_string(tags, '、') AS tags, coalesce(ordered, '') AS ordered, institution_name, CASE WHEN trim(coalesce(institution_name, '')) <> '' THEN concat('root/', trim(institution_name), '/', j.img_id, '.jpg') END AS img_path FROM j LEFT JOIN ord USING (img_id)""",
    "composite_lookup": f"WITH {_SHEET_SQL} SELECT patient_record_id, eye_side, arg_min(img_id, ord) AS img_id FROM r GROUP BY patient_record_id, eye_side",
    "lookup_conflicts": f"WITH {_SHEET_SQL} SELECT patient_record_id, eye_side, count(DISTINCT img_id) AS images FROM r GROUP BY patient_record_id, eye_side HAVING count(DISTINCT img_id) > 1",
    "report_hash": "SELECT item_id, substr(sha1(trim(text)), 1, 16) AS hash FROM benchmark",
}
