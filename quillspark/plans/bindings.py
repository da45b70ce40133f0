"""Driver tables stood in for the input relations: one list of SQL expressions for Spark and for the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..operators.report import report_text

LABELS = (*dims.DIAGNOSIS_ORDER, "玻璃体浑浊", "杯盘比偏大", "视盘水肿", "血管硬化轻度", "血管硬化重度", "黄斑区异常", "豹纹状眼底中度", "黄斑区大玻璃膜疣", "视网膜激光斑", "糖尿病视网膜病变增殖期", "未知标签")


def _counts() -> dict[str, str]:
    out = {}
    for j, prefix in enumerate([p for p, *_ in dims.COUNTED] + [dims.LASER]):
        for i, q in enumerate(dims.QUADRANTS):
            out[prefix + q] = f"greatest((k * {2 * j + 3} + {7 * i}) % {11 + 2 * j} - {6 + j}, 0)"
    blood = "bloodnumberdistribution_"
    out |= {blood + "inferiornasal": "k % 7", blood + "inferiortemporal": "greatest(k % 5 - 2, 0)", blood + "superiornasal": "greatest(k % 11 - 6, 0)", blood + "superiortemporal": "(k % 31) * (CASE WHEN k % 17 = 0 THEN 3 ELSE 1 END)"}
    for j, (prefix, _, macula, *_) in enumerate(dims.COUNTED):
        if macula:
            out[prefix + "r2"] = f"CASE WHEN k % {5 + j} = 0 THEN 1 ELSE 0 END"
    return out


COUNTS = _counts() | {
    "discbloodnumber": "CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END",
    "ratioatrophymaxwidth": "greatest(k % 8 - 5, 0)",
    "arteriovenouscrossingnumber": "greatest(k % 13 - 9, 0)",
    "atrophicfocinumber": "greatest(k % 19 - 16, 0)",
    "lacquercracknumber": "greatest(k % 23 - 20, 0)",
    "rnfldarea": "greatest(k % 29 - 25, 0)",
}
FIRST, SECOND = f"(k % {len(LABELS)}) + 1", f"((k * 7 + 3) % {len(LABELS)}) + 1"


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


#: Rows of a piece that one task works on; a report of each costs some tenths of a millisecond.
PIECE_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, in pieces of at most some ``PIECE_ROWS`` rows, if it is read in fewer; for narrow rows that costly expressions follow. So no
    task grows with the table, however few row groups its files have. The rows are counted from the files' footers."""
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PIECE_ROWS))
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one measurement row an order."""
    keys = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_orderstatus AS status"))
    labels = f"array({quoted(LABELS)})"
    # A projection with a lambda is compiled in small methods; all these columns in one method of a whole stage would be too large for the JVM's compiler.
    tags = f"filter(CASE WHEN k % 3 = 0 THEN array(element_at({labels}, CAST({FIRST} AS int)), element_at({labels}, CAST({SECOND} AS int))) ELSE array(element_at({labels}, CAST({FIRST} AS int))) END, t -> t IS NOT NULL)"
    return keys.selectExpr("k AS ord", "CAST(k AS string) AS img_id", "(1 + k % 8) / 10.0D AS ratiocdv", *[f"CAST({e} AS double) AS {n}" for n, e in COUNTS.items()], f"{tags} AS tags", "status AS institution_name", "concat('root/', status, '/', k, '.jpg') AS img_path")


_labels = f"[{quoted(LABELS)}]"
PARAMETER_SQL = f"""
b1 AS (
  SELECT k AS ord, CAST(k AS VARCHAR) AS img_id, (1 + k % 8) AS tenths, {", ".join(f"{e} AS {n}" for n, e in COUNTS.items())},
    CASE WHEN k % 3 = 0 THEN [list_extract({_labels}, {FIRST}), list_extract({_labels}, {SECOND})] ELSE [list_extract({_labels}, {FIRST})] END AS tags,
    status AS institution_name, concat('root/', status, '/', k, '.jpg') AS img_path
  FROM (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders)
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: (ord, img_id, reference, prediction); the prediction is the report after a fixed change by the key's last digit."""
    rows = parameter(spark, sf_dir)
    text = report_text(rows.select("*")).select("img_id", F.col("description").alias("reference"))
    keyed = text.withColumn("ord", F.col("img_id").cast("long"))
    d = F.col("ord") % 10
    description = F.regexp_extract("reference", "^描述：([^\n]*)", 1)
    diagnosis = F.regexp_extract("reference", "初步诊断：([^\n]*)", 1)
    tenths = (1 + F.col("ord") % 8).cast("string")
    moved = (1 + F.col("ord") % 8 + 1 + F.col("ord") % 2).cast("int")
    prediction = (
        F.when(d <= 4, F.col("reference"))
        .when(d == 5, F.concat(F.lit("描述："), description, F.lit("\n初步诊断："), F.regexp_replace(diagnosis, "^[^、]*、?", "")))
        .when(d == 6, F.concat("reference", F.lit("、疑似青光眼")))
        .when(d == 7, F.replace("reference", F.concat(F.lit("杯盘比为0."), tenths), F.concat(F.lit("杯盘比为"), F.floor(moved / 10).cast("string"), F.lit("."), (moved % 10).cast("string"))))
        .when(d == 8, F.concat(F.lit("初步诊断："), diagnosis, F.lit("\n描述："), description))
        .otherwise(F.lit(""))
    )
    return keyed.select("ord", "img_id", "reference", prediction.alias("prediction"))
