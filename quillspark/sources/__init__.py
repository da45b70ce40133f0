"""Readers and writers with the options that report data need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import listed_files

ANNOTATION = "_id BIGINT, _name STRING, tag ARRAY<STRUCT<_label: STRING, attribute: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>>>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **constants: str) -> DataFrame:
    """Header CSV with quoted line breaks; all columns are text unless ``schema`` says otherwise; ``constants`` are added."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.withColumns({k: F.lit(v) for k, v in constants.items()}) if constants else rows


def write_csv(rows: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """CSV of the fields in their order; a field that is missing is blank, a column that isn't a field is an error."""
    extra = set(rows.columns) - set(fields)
    if extra:
        raise ValueError(f"no such fields: {sorted(extra)}")
    blank = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in rows.columns else F.lit("").alias(f) for f in fields]
    rows.select(*blank).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """``rows``, as a file source reads them, with their file's ``path`` and their place in it (from 1), over all splits of the file.

    A split's rows have consecutive ids, so the place in the split is the distance to its first id; the rows of the splits before are added. What is
    summed and joined is one row a split. Call it before any filter: every row that was read counts.
    """
    at = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start")
    read = rows.select(*rows.columns, *at).withColumn("__id", F.monotonically_increasing_id())
    splits = read.groupBy("path", "__start").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("__start")) - F.col("__n")
    splits = splits.select(F.col("path").alias("__path"), F.col("__start").alias("__of"), "__first", before.alias("__before"))
    joined = read.join(splits, (F.col("path") == F.col("__path")) & (F.col("__start") == F.col("__of")))
    return joined.select(*rows.columns, "path", (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias(name))


def in_order(rows: DataFrame, name: str = "ord", place: str = "place") -> DataFrame:
    """``placed`` rows with one number over all files, from 1: by path and then by place. One row a file is ranked."""
    files = rows.groupBy("path").agg(F.max(place).alias("__n"))
    before = files.select(F.col("path").alias("__path"), (F.sum("__n").over(Window.orderBy("path")) - F.col("__n")).alias("__before"))
    return rows.join(before, F.col("path") == F.col("__path")).withColumn(name, F.col("__before") + F.col(place)).drop("__path", "__before")


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of the lines that aren't JSON; blank lines are none of them, but count."""
    lines = placed(spark.read.text(path), "line")
    return lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull()).select("path", "line", F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line is dropped or, if ``strict``, an error at once that names its file and number. Blank lines don't count."""
    if strict:
        bad = bad_json_lines(spark, path).agg(F.min(F.struct("path", "line")).alias("x")).first()["x"]
        if bad:
            raise ValueError(f"not JSON: {bad['path']}:{bad['line']}")
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_document(row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as one JSON document."""
    row.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, name, free_text, label_text) of the images of annotation files; ``ord`` is an image's place in the document, from 1, files in order of
    their paths. Ids may have gaps and need not be in order."""
    rows = in_order(placed(spark.read.format("xml").option("rowTag", "image").schema(ANNOTATION).load(path)))
    flat = F.flatten(F.transform(F.coalesce("tag", F.array().cast("array<struct<_label:string,attribute:array<struct<_name:string,_VALUE:string>>>>")), lambda t: F.transform(t["attribute"], lambda a: F.struct(t["_label"].alias("l"), a["_name"].alias("n"), a["_VALUE"].alias("v")))))
    of = lambda label, name: F.coalesce(F.trim(F.element_at(F.transform(F.filter("__a", lambda x: (x["l"] == label) & (x["n"] == name)), lambda x: x["v"]), -1)), F.lit(""))
    rows = rows.withColumn("__a", flat)
    with_value = lambda label, name: F.when(F.exists("__a", lambda x: (x["l"] == label) & (x["n"] == name)), of(label, name)).otherwise(F.lit(""))
    return rows.select("ord", F.col("_id").alias("id"), F.col("_name").alias("name"), with_value("自由文本", "自由文本").alias("free_text"), with_value("EVisionAI_disease_Tag", "EVisionAI疾病分类").alias("label_text"))


def list_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")) -> DataFrame:
    """(path, stem, bytes) of the image files under ``root``; their contents aren't read."""
    files = listed_files(spark, root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*extensions)).select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), "bytes")


def below(path: str, root: str) -> Column:
    """What follows the folder ``root`` in a path below it, however the file system spells what stands before the last two names of ``root``."""
    return F.substring_index(path, "/" + "/".join(root.rstrip("/").split("/")[-2:]) + "/", -1)


def image_index(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stem, path) by the first path of each stem, and the stems that occur more than once."""
    counted = files.groupBy("stem").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    return counted.select("stem", "path"), counted.where("n > 1").select("stem", "n")


def resolved_paths(rows: DataFrame, files: DataFrame, path: str, key: str, base: str = "") -> DataFrame:
    """``rows`` with ``resolved``: the path itself if it is listed, else below ``base``, else the index's file for the key."""
    listed = files.select("path").distinct()
    index = image_index(files)[0]
    joined = rows.join(listed.select(F.col("path").alias("__a"), F.col("path").alias("__fa")), F.col(path) == F.col("__a"), "left")
    joined = joined.join(listed.select(F.col("path").alias("__b"), F.col("path").alias("__fb")), F.concat(F.lit(base), F.col(path)) == F.col("__b"), "left")
    joined = joined.join(index.select(F.col("stem").alias("__s"), F.col("path").alias("__fi")), F.col(key) == F.col("__s"), "left")
    return joined.select(*rows.columns, F.coalesce("__fa", "__fb", "__fi").alias("resolved"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, md): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md"))
