"""Queries that write a table's rows by a sink and read them back by the source that goes with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import rank, resume, split, sync
from ..session import work_path
from ..sources import runs, workbook
from ..sources.files import write_files
from ..streaming import reports as streamed
from . import markup


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _csv(s, d):
    rows = _table(s, d, "documents").select("doc_id", F.concat(F.lit('a "quoted" line\n'), F.col("lang")).alias("answer"), "source")
    path = work_path(s, "csv")
    sources.write_csv(rows, path, ["doc_id", "answer", "source", "missing"])
    return sources.read_csv(s, path, prompt="p").select(F.col("doc_id").cast("long").alias("doc_id"), "answer", "source", F.coalesce("missing", F.lit("")).alias("missing"), "prompt")


def _jsonl(s, d):
    rows, path = _table(s, d, "documents").select("doc_id", "text", "lang"), work_path(s, "jsonl")
    for part in (0, 1):
        sources.append_jsonl(rows.where(F.col("doc_id") % 2 == part), path)
    return sources.read_jsonl(s, path, "doc_id long, text string, lang string")


def _lax(s, d):
    path = work_path(s, "lines")
    good = F.concat(F.lit('{"input": "'), F.col("event_id").cast("string"), F.lit('", "n": 1}'))
    _table(s, d, "events").select(F.when(F.col("event_id") % 5 == 0, F.substring(good, 1, 9)).when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(good).alias("value")).write.text(path)
    return sources.read_jsonl(s, path, "input string, n long", strict=False)


def _document(s, d):
    path = work_path(s, "json")
    sources.write_document(_table(s, d, "supplier").select("s_suppkey", "s_name"), path)
    return sources.read_jsonl(s, path, "s_suppkey long, s_name string")


# Ids that aren't places: they have gaps, begin at 7 and go down.
_XML_ID = "(7 + 3 * (20000000 - o_orderkey))"


def _xml(s, d):
    """Annotation markup of each order: two labels' attributes, or free text, or no tag."""
    path = work_path(s, "xml")
    tag = "concat('<tag label=\"{0}\"><attribute name=\"{1}\">', {2}, '</attribute></tag>')"
    label, free = tag.format("EVisionAI_disease_Tag", "EVisionAI疾病分类", "concat('None\"', o_orderpriority, '\"')"), tag.format("自由文本", "自由文本", "' 模糊 '")
    name = "concat('r', CAST(o_custkey AS STRING), '.0_x_', CASE o_orderkey % 3 WHEN 0 THEN 'OD' WHEN 1 THEN 'os' ELSE 'XX' END, '.jpg')"
    rows = _table(s, d, "orders").selectExpr("o_orderkey", f"concat('<image id=\"', CAST({_XML_ID} AS STRING), '\" name=\"', {name}, '\">\n', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN {free} WHEN 2 THEN {label} ELSE concat({label}, '\n', {free}) END, '\n</image>') AS x")
    # A file holds one document of some thousand images.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "x"))), lambda r: r["x"])
    documents = rows.groupBy(F.lpad(F.floor(F.col("o_orderkey") / 10_000).cast("string"), 9, "0").alias("nth")).agg(F.concat(F.lit("<annotations>\n"), F.array_join(listed, "\n"), F.lit("\n</annotations>")).alias("value"))
    documents.withColumn("nth", F.concat(F.lit("f"), "nth")).write.partitionBy("nth").text(path)
    return sources.read_annotations(s, path)


def _markdown(s, d):
    path = work_path(s, "md")
    _table(s, d, "nation").select("n_nationkey", F.concat(F.lit("# "), "n_name", F.lit("\nline\n")).alias("value")).write.partitionBy("n_nationkey").text(path)
    return sources.read_markdown(s, path).select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("long").alias("n_nationkey"), F.trim(F.replace("md", F.lit("\n"), F.lit(" "))).alias("md"))


def _listing(s, d):
    """A file a part and supplier: images and others below several folders, some names in two of them."""
    path = work_path(s, "images")
    one = "concat(CASE {0} % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' ELSE 'c/d/' END, 'i', CAST({0} AS STRING), CASE {0} % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.x.webp' ELSE '.txt' END) AS name"
    rows = _table(s, d, "part").selectExpr(one.format("p_partkey"), "p_name AS content").unionAll(_table(s, d, "supplier").selectExpr("concat('e/i', CAST(s_suppkey AS STRING), '.jpeg')", "s_name"))
    write_files(rows, path)
    return sources.list_images(s, path).withColumn("name", sources.below("path", path))


def _bad_lines(s, d):
    """Event records as JSON lines in four files, one in seven cut off, one in five blank."""
    path = work_path(s, "lines")
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"input": '), F.col("event_id").cast("string"))).when(F.col("event_id") % 5 == 0, F.lit("  ")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    rows = _table(s, d, "events").select((F.col("event_id") % 4).alias("nth"), "event_id", line.alias("value"))
    rows.repartition(4, "nth").sortWithinPartitions("nth", "event_id").select("nth", "value").write.partitionBy("nth").text(path)
    return sources.bad_json_lines(s, path).select(F.regexp_extract("path", "nth=([0-9]+)", 1).cast("long").alias("nth"), "line", "text")


def _workbook(s, d):
    """Suppliers and parts as two sheets of a workbook for each remainder of their keys, read back by the sheets' names."""
    path = work_path(s, "books")
    suppliers = _table(s, d, "supplier").selectExpr("CAST(s_suppkey % 8 AS STRING) AS nth", "s_suppkey", "concat(' ', s_name, ' <&> \"x\"') AS `Name of`", "CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_acctbal AS STRING) END AS balance")
    parts = _table(s, d, "part").selectExpr("CAST(p_partkey % 8 AS STRING) AS nth", "p_partkey", "p_name", "p_size")
    workbook.write_workbooks({"sheet of suppliers": (suppliers, "s_suppkey"), "parts": (parts, "p_partkey")}, path, "nth")
    first = workbook.read_sheet(s, path, "sheet of suppliers").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("long").alias("key"), F.col("Name of").alias("name"), F.col("balance").alias("other"), "place")
    return first.unionAll(workbook.read_sheet(s, path, "parts").select(F.lit("part"), F.col("p_partkey").cast("long"), "p_name", "p_size", "place"))


def _streamed(s, d):
    """Reports that arrive in two deliveries, the second with some of the first again in other words; the stream ends and starts again in between."""
    arrivals, out, checkpoint = (work_path(s, n) for n in ("arrivals", "extracted", "stream"))
    reports = markup.reports(s, d)
    stream = lambda: s.readStream.schema("o_orderkey long, md string").json(f"{arrivals}/*")
    reports.where("o_orderkey % 2 = 0").write.option("compression", "gzip").json(f"{arrivals}/first")
    streamed.extract_arrivals(stream(), out, checkpoint, "o_orderkey")
    again = reports.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("性别: 改\n").alias("md"))
    reports.where("o_orderkey % 2 = 1").unionByName(again).write.option("compression", "gzip").json(f"{arrivals}/second")
    streamed.extract_arrivals(stream(), out, checkpoint, "o_orderkey")
    return markup.told(streamed.extracted(s, out))


def _resumed(s, d):
    """Records of a run that stopped after a third of its tasks and was resumed; what an interrupted write had staged doesn't count."""
    root, settings = work_path(s, "run"), {"beams": 1, "dtype": "bf16"}
    tasks = _table(s, d, "events").select("event_id", "value")
    output = runs.RunOutput(s, root)
    work = lambda by: lambda rows: rows.select("event_id", F.round("value", 6).alias("value"), F.lit(by).alias("run"))
    output.run(tasks.where("event_id % 3 = 0"), "event_id", work(1), settings)
    work(9)(tasks).write.parquet(f"{root}/parts/interrupted")
    output.run(tasks, "event_id", work(2), settings, resume=True)
    return output.read()


def _history(s, d):
    """Trainer states, a document for each 1000 events: training records, evaluation records and some with both losses, some without a step or an epoch."""
    path = work_path(s, "states")
    e = _table(s, d, "events").where("value IS NOT NULL")
    entry = F.struct(
        F.col("event_id").alias("nth"),
        F.struct(F.when(F.col("event_id") % 11 != 0, F.col("event_id")).alias("step"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") / 100).alias("epoch"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("loss"), F.when(F.col("event_id") % 4 == 0, F.col("value") * 2).alias("eval_loss")).alias("x"),
    )
    log = F.transform(F.array_sort(F.collect_list(entry)), lambda r: r["x"])
    e.groupBy(F.expr("event_id DIV 1000").alias("nth")).agg(F.to_json(F.struct(log.alias("log_history"))).alias("value")).write.partitionBy("nth").text(path)
    found = rank.loss_series(rank.read_history(s, path), "ord", epoch="epoch")
    return found.select(F.col("step").cast("long").alias("step"), F.round("epoch", 6).alias("epoch"), "kind", F.round("value", 9).alias("value"))


def _kept(s, d):
    """Rows of documents cleaned by the labelled ids, as the written parts hold them, and the counts of the pass that wrote them."""
    path = work_path(s, "cleaned")
    rows = _table(s, d, "documents").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("key"), "lang")
    counts = split.write_kept_and_removed(rows, _table(s, d, "labels").select(F.col("doc_id").alias("k")), "key", path, "k")
    back = s.read.parquet(path).groupBy().agg(F.count_if("kept").alias("kept_written"), F.count_if(~F.col("kept")).alias("removed_written"))
    return back.select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()], "kept_written", "removed_written")


def _left(s, d):
    path = work_path(s, "pending")
    e = _table(s, d, "events")
    tasks = e.select(F.col("event_id").alias("input"), F.concat(F.lit("out/"), F.col("event_id").cast("string")).alias("output"))
    outputs, log = tasks.where("input % 4 = 0").select("output"), tasks.where("input % 3 = 0").select("input")
    counts = resume.write_pending(tasks, outputs.unionAll(outputs), log, "input", "output", path)
    return s.read.parquet(path).agg(F.count("*").alias("written")).select("written", *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


def _paths(s, d):
    """Listed files below two roots, and rows whose path is whole, relative, wrong or blank."""
    parts = _table(s, d, "part")
    files = parts.where("p_partkey % 5 <> 0").selectExpr("concat('/data/', CASE p_partkey % 2 WHEN 0 THEN 'a' ELSE 'b' END, '/', CAST(p_partkey AS STRING), '.jpg') AS path", "CAST(p_partkey AS STRING) AS stem")
    rows = parts.selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('/data/a/', CAST(p_partkey AS STRING), '.jpg') WHEN 1 THEN concat('a/', CAST(p_partkey AS STRING), '.jpg') ELSE ' ' END AS img_path", "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(p_partkey AS STRING) END AS img_id")
    return rows, files


QUERIES = {
    "csv_round_trip": _csv,
    "jsonl_round_trip": _jsonl,
    "jsonl_lax": _lax,
    "json_documents": _document,
    "annotation_xml": _xml,
    "bad_json_lines": _bad_lines,
    "workbook_sheets": _workbook,
    "streamed_reports": _streamed,
    "resumed_run": _resumed,
    "loss_history": _history,
    "written_filter_summary": _kept,
    "written_skip_counts": _left,
    "xml_subset": lambda s, d: sync.subset_entries(_xml(s, d), 400)[0].select("ord", "patient_record_id", "eye_side"),
    "xml_invalid_names": lambda s, d: sync.subset_entries(_xml(s, d), 400)[1],
    "markdown_files": _markdown,
    "file_listing": lambda s, d: _listing(s, d).select("name", "stem", "bytes"),
    "duplicate_stems": lambda s, d: sources.image_index(_listing(s, d))[1],
    "image_index": lambda s, d: sources.image_index(_listing(s, d).withColumn("path", F.col("name")))[0].select("stem", F.col("path").alias("name")),
    "resolved_paths": lambda s, d: sources.resolved_paths(*_paths(s, d), "img_path", "img_id", "/data/").select("p_partkey", "resolved"),
    "existing_files": lambda s, d: sync.existing_only(*(x.withColumnRenamed("img_path", "path") for x in _paths(s, d)), "path")[0].select("p_partkey"),
    "missing_files": lambda s, d: sync.existing_only(*(x.withColumnRenamed("img_path", "path") for x in _paths(s, d)), "path")[1],
}
_NAME = "concat('r', o_custkey, '.0_x_', CASE o_orderkey % 3 WHEN 0 THEN 'OD' WHEN 1 THEN 'os' ELSE 'XX' END, '.jpg')"
_FIRST = "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS ord FROM orders) WHERE ord <= 400)"
_FILES = """WITH files AS (
  SELECT concat(CASE p_partkey % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' ELSE 'c/d/' END, 'i', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' ELSE '.x.webp' END) AS name,
    concat('i', p_partkey, CASE p_partkey % 4 WHEN 2 THEN '.x' ELSE '' END) AS stem, CAST(strlen(p_name) AS BIGINT) AS bytes FROM part WHERE p_partkey % 4 < 3
  UNION ALL SELECT concat('e/i', s_suppkey, '.jpeg'), concat('i', s_suppkey), CAST(strlen(s_name) AS BIGINT) FROM supplier)"""
_THERE = "p_partkey % 5 <> 0"
ORACLE_SQL = {
    "csv_round_trip": "SELECT doc_id, 'a \"quoted\" line' || chr(10) || lang AS answer, source, '' AS missing, 'p' AS prompt FROM documents",
    "jsonl_round_trip": "SELECT doc_id, text, lang FROM documents",
    "jsonl_lax": "SELECT CAST(event_id AS VARCHAR) AS input, CAST(1 AS BIGINT) AS n FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0",
    "json_documents": "SELECT s_suppkey, s_name FROM supplier",
    "annotation_xml": f"SELECT row_number() OVER (ORDER BY o_orderkey) AS ord, {_XML_ID} AS id, {_NAME} AS name, CASE WHEN o_orderkey % 4 IN (1, 3) THEN '模糊' ELSE '' END AS free_text, CASE WHEN o_orderkey % 4 IN (2, 3) THEN 'None\"' || o_orderpriority || '\"' ELSE '' END AS label_text FROM orders",
    "xml_subset": f"{_FIRST} SELECT ord, concat('r', o_custkey, '.0') AS patient_record_id, CASE o_orderkey % 3 WHEN 0 THEN 'right' ELSE 'left' END AS eye_side FROM f WHERE o_orderkey % 3 <> 2",
    "xml_invalid_names": f"{_FIRST} SELECT ord, {_NAME} AS name FROM f WHERE o_orderkey % 3 = 2",
    "bad_json_lines": """WITH r AS (SELECT event_id % 4 AS nth, event_id, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line FROM events)
SELECT nth, line, concat('{"input": ', event_id) AS text FROM r WHERE event_id % 7 = 0""",
    "workbook_sheets": """SELECT 'supplier' AS kind, s_suppkey AS key, concat(' ', s_name, ' <&> "x"') AS name, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_acctbal AS VARCHAR) END AS other, row_number() OVER (PARTITION BY s_suppkey % 8 ORDER BY s_suppkey) AS place FROM supplier
UNION ALL SELECT 'part', p_partkey, p_name, CAST(p_size AS VARCHAR), row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) FROM part""",
    "streamed_reports": markup.ORACLE_SQL["report_extract"],
    "resumed_run": "SELECT event_id, round(value, 6) AS value, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM events",
    "loss_history": """SELECT event_id AS step, CASE WHEN event_id % 7 <> 0 THEN round(event_id / 100::DOUBLE, 6) ELSE 0 END AS epoch, CASE WHEN event_id % 4 = 0 THEN 'eval' ELSE 'train' END AS kind, round(CASE WHEN event_id % 4 = 0 THEN value * 2 ELSE value END, 9) AS value
FROM events WHERE value IS NOT NULL AND event_id % 11 <> 0 AND (event_id % 4 = 0 OR event_id % 3 <> 0)""",
    "written_filter_summary": """SELECT *, kept AS kept_written, removed AS removed_written FROM (
  SELECT count(*) AS rows, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS kept, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS removed, (SELECT count(DISTINCT doc_id) FROM labels) AS clean_keys FROM documents)""",
    "written_skip_counts": """SELECT *, pending AS written FROM (
  SELECT count(*) AS tasks, count(*) FILTER (event_id % 4 = 0) AS skipped_output, count(*) FILTER (event_id % 4 <> 0 AND event_id % 3 = 0) AS skipped_log, count(*) FILTER (event_id % 4 <> 0 AND event_id % 3 <> 0) AS pending FROM events)""",
    "markdown_files": "SELECT n_nationkey, '# ' || n_name || ' line' AS md FROM nation",
    "file_listing": f"{_FILES} SELECT * FROM files",
    "duplicate_stems": f"{_FILES} SELECT stem, count(*) AS n FROM files GROUP BY stem HAVING count(*) > 1",
    "image_index": f"{_FILES} SELECT stem, min(name) AS name FROM files GROUP BY stem",
    "resolved_paths": f"""SELECT p_partkey, CASE WHEN {_THERE} AND p_partkey % 2 = 0 AND p_partkey % 3 < 2 OR {_THERE} AND p_partkey % 7 <> 0
  THEN concat('/data/', CASE p_partkey % 2 WHEN 0 THEN 'a' ELSE 'b' END, '/', p_partkey, '.jpg') END AS resolved FROM part""",
    "existing_files": f"SELECT p_partkey FROM part WHERE {_THERE} AND p_partkey % 3 = 0 AND p_partkey % 2 = 0",
    "missing_files": f"SELECT count(*) AS missing FROM part WHERE NOT ({_THERE} AND p_partkey % 3 = 0 AND p_partkey % 2 = 0)",
}
