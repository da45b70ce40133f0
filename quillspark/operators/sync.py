"""Labels of images from several keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import column_by_aliases, excluded, eye_side, identifier, image_id, normalized_tag, or_empty, record_of, sided_tags, strip, tag_list
from .extract import held


def image_sides(diseases: DataFrame) -> DataFrame:
    """(img_id, eye_side): the first side of an image that isn't blank."""
    rows = diseases.select(strip(or_empty(F.col("img_id"))).alias("img_id"), "ord", F.lower(strip(or_empty(F.col("eye_side")))).alias("s")).where("img_id <> ''")
    return rows.groupBy("img_id").agg(F.coalesce(F.min_by("s", F.when(F.col("s") != "", F.col("ord"))), F.lit("")).alias("eye_side"))


def image_labels(diseases: DataFrame, items: Column) -> DataFrame:
    """(img_id, tags): labels of all an image's rows, in row and list order, once each."""
    rows = diseases.select(strip(or_empty(F.col("img_id"))).alias("img_id"), "ord", F.posexplode(items).alias("pos", "t")).where("img_id <> ''")
    rows = rows.select("img_id", F.struct("ord", "pos", normalized_tag(F.col("t")).alias("t")).alias("x")).where("x.t <> ''")
    return rows.groupBy("img_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])).alias("tags"))


def image_sides_and_labels(diseases: DataFrame, items: Column) -> DataFrame:
    """(img_id, eye_side, tags): ``image_sides`` and ``image_labels`` by one aggregate of the rows."""
    rows = diseases.select(strip(or_empty(F.col("img_id"))).alias("img_id"), "ord", F.lower(strip(or_empty(F.col("eye_side")))).alias("s"), F.posexplode_outer(items).alias("pos", "t")).where("img_id <> ''")
    rows = rows.withColumn("t", normalized_tag(F.col("t")))
    side = F.coalesce(F.min_by("s", F.when(F.col("s") != "", F.col("ord"))), F.lit("")).alias("eye_side")
    listed = F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("ord", "pos", "t"))))  # nulls aren't collected
    return rows.groupBy("img_id").agg(side, F.array_distinct(F.transform(listed, lambda x: x["t"])).alias("tags"))


def patient_labels(patients: DataFrame, ids: Column, abnormal: Column, images: DataFrame) -> DataFrame:
    """(img_id, tags, institution_name): a patient's labels that hold for the image's side, then its own (``images``: img_id, eye_side,
    tags); the last patient row wins."""
    rows = patients.select("ord", "institution_name", abnormal.alias("abnormal"), F.posexplode(ids).alias("pos", "i")).withColumn("img_id", strip(or_empty(F.col("i")))).where("img_id <> ''")
    last = rows.groupBy("img_id").agg(F.max_by(F.struct("institution_name", "abnormal"), F.struct("ord", "pos")).alias("x")).select("img_id", "x.*")
    none = F.array().cast("array<string>")
    own = sided_tags(F.coalesce("abnormal", none), F.coalesce("eye_side", F.lit("")))
    return last.join(images, "img_id", "left").select("img_id", F.array_distinct(F.concat(own, F.coalesce("tags", none))).alias("tags"), "institution_name")


def annotations(images: DataFrame) -> DataFrame:
    """(img_id, tags, excluded) of annotation rows (ord, name, free_text, label_text); an image's last entry wins, but any
    entry's free text excludes it."""
    rows = images.select("ord", image_id(F.col("name")).alias("img_id"), tag_list(F.col("label_text")).alias("tags"), excluded(F.col("free_text")).alias("bad")).where("img_id <> ''")
    return rows.groupBy("img_id").agg(F.max_by("tags", "ord").alias("tags"), F.bool_or("bad").alias("excluded"))


def synced(parameter: DataFrame, labels: DataFrame, annotated: DataFrame, root: str = "root") -> DataFrame:
    """``parameter`` with tags, institution_name and img_path: annotated labels replace others (even by none), excluded images
    go, and a path needs both its parts."""
    base = parameter.drop("tags", "institution_name", "img_path")
    rows = base.join(labels.withColumnRenamed("tags", "__own"), "img_id", "left").join(annotated.selectExpr("img_id", "tags AS __xml", "excluded AS __bad"), "img_id", "left")
    rows = rows.where(~F.coalesce("__bad", F.lit(False)))
    tags = F.when(F.col("__bad").isNotNull(), F.col("__xml")).otherwise(F.coalesce("__own", F.array().cast("array<string>")))
    whole = (strip(or_empty(F.col("institution_name"))) != "") & (strip(F.col("img_id")) != "")
    path = F.when(whole, F.concat_ws("/", F.lit(root), strip(F.col("institution_name")), F.concat(strip(F.col("img_id")), F.lit(".jpg"))))
    return rows.select(*base.columns, tags.alias("tags"), "institution_name", path.alias("img_path"))


def existing_only(rows: DataFrame, files: DataFrame, column: str = "img_path") -> tuple[DataFrame, DataFrame]:
    """Rows whose file is listed, and one row with how many aren't."""
    listed = files.select(F.col("path").alias(column)).distinct()
    return rows.join(listed, column, "left_semi").select(*rows.columns), rows.join(listed, column, "left_anti").agg(F.count("*").alias("missing"))


def composite_lookup(diseases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patient_record_id, eye_side, img_id) by the first row of each key, and the keys with several images. Columns are found by
    their aliases; ids and sides are put in their plain form, and rows that lack one go."""
    column = {n: F.col(f"`{column_by_aliases(diseases.columns, a)}`") for n, a in dims.COLUMN_ALIASES.items()}
    plain = {"patient_record_id": identifier, "eye_side": eye_side, "img_id": identifier}
    # The plain forms are worked out once, not in the filter and again above it.
    raw = diseases.select(*[column[n].cast("string").alias(f"__{n}") for n in plain], "ord")
    rows = held(raw, **{n: f(F.col(f"__{n}")) for n, f in plain.items()}).where("patient_record_id <> '' AND eye_side <> '' AND img_id <> ''")
    # One row an image of a key first: then its images are counted without a distinct aggregate, by the same exchange's keys.
    rows = rows.groupBy("patient_record_id", "eye_side", "img_id").agg(F.min("ord").alias("ord"))
    keyed = rows.groupBy("patient_record_id", "eye_side").agg(F.min_by("img_id", "ord").alias("img_id"), F.count("*").alias("images"))
    return keyed.drop("images"), keyed.where("images > 1").select("patient_record_id", "eye_side", "images")


def subset_entries(images: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Record and side of the first ``limit`` images in document order (``ord``, from 1, as ``read_annotations`` gives it), and the names of those that have
    none; these count toward the limit."""
    rows = images.where(F.col("ord") <= limit).withColumn("__r", record_of(F.col("name")))
    good = rows.where("__r IS NOT NULL").select("ord", "name", F.col("__r.record").alias("patient_record_id"), F.col("__r.side").alias("eye_side"), "free_text", "label_text")
    return good, rows.where("__r IS NULL").select("ord", "name")


def subset_parameter(entries: DataFrame, lookup: DataFrame, parameter: DataFrame, key: str = "img_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parameter rows of a subset's images with the entries' tags, the entries (ord, name) without an image, and the images (img_id) that are excluded.

    An entry's image is the look-up's for its record and side. An image's last entry gives its tags, and any entry's free text excludes it. Parameter rows
    match by the plain form of their ids, which replaces them; rows that share an id are all kept.
    """
    on = ["patient_record_id", "eye_side"]
    met = entries.join(lookup.select(*on, F.col("img_id").alias("__i")), on, "left").select("ord", "name", "__i", tag_list(F.col("label_text")).alias("t"), excluded(F.col("free_text")).alias("bad"))
    images = met.where("__i IS NOT NULL").groupBy("__i").agg(F.max_by("t", "ord").alias("__t"), F.bool_or("bad").alias("__bad"))
    rows = parameter.withColumn(key, identifier(F.col(key).cast("string"))).join(images.where("NOT __bad"), F.col(key) == F.col("__i"))
    kept = rows.select(*[c for c in parameter.columns if c != "tags"], F.col("__t").alias("tags"))
    return kept, met.where("__i IS NULL").select("ord", "name"), images.where("__bad").select(F.col("__i").alias("img_id"))
