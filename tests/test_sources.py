"""Readers and writers on files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import sources
from quillspark.operators import resume, split, sync
from quillspark.sources import runs, workbook
from quillspark.streaming import reports


def test_csv_round_trip_with_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a\n"b", c', None), ("2", "x", "y")], "img_id string, answer string, extra string")
    path = str(tmp_path / "csv")
    sources.write_csv(rows, path, ["img_id", "answer", "extra", "missing"])
    back = sources.read_csv(spark, path, prompt="p").orderBy("img_id").collect()
    assert back[0]["answer"] == 'a\n"b", c' and back[1]["prompt"] == "p" and len(back) == 2
    with pytest.raises(ValueError):
        sources.write_csv(rows, path, ["img_id"])


def test_byte_order_mark_is_dropped(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿img_id,a\n1,2\n".encode())
    assert sources.read_csv(spark, str(tmp_path / "x.csv")).columns == ["img_id", "a"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"input": "a"}\n\nnot json\n{"input": "b"}\n')
    lax = sources.read_jsonl(spark, str(tmp_path / "x.jsonl"), "input string", strict=False)
    assert sorted(r["input"] for r in lax.collect()) == ["a", "b"]
    with pytest.raises(Exception):  # noqa: B017
        sources.read_jsonl(spark, str(tmp_path / "x.jsonl"), "input string").collect()


def test_strict_lines_name_file_and_number_over_splits(spark, tmp_path):
    lines = [f'{{"input": "{k}"}}' if k % 50 else ("" if k % 100 else f"bad {k}") for k in range(1, 2001)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "y.jsonl").write_text('{"input": 1}\n[1, 2\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        bad = {(r["path"].rsplit("/", 1)[1], r["line"], r["text"]) for r in sources.bad_json_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert bad == {("x.jsonl", k, f"bad {k}") for k in range(100, 2001, 100)} | {("y.jsonl", 2, "[1, 2")}
    with pytest.raises(ValueError, match=r"x\.jsonl:100$"):
        sources.read_jsonl(spark, str(tmp_path), "input string")
    assert sources.read_jsonl(spark, str(tmp_path), "input string", strict=False).count() == 2000 - 40 + 1


def test_annotations_are_in_document_order_whatever_their_ids(spark, tmp_path):
    entry = '<image id="{}" name="{}">{}</image>'
    tag = '<tag label="{0}"><attribute name="{1}">{2}</attribute></tag>'
    good = tag.format("EVisionAI_disease_Tag", "EVisionAI疾病分类", 'None"视盘水肿", "视盘水肿",')
    bad = tag.format("自由文本", "自由文本", "4")
    (tmp_path / "a.xml").write_text("<annotations>" + entry.format(9, "r_x_OD_i1.jpg", good) + entry.format(2, "r_x_OS_i2.jpg", bad) + entry.format(2, "r_x_OS_i1.jpg", "") + "</annotations>", encoding="utf-8")
    (tmp_path / "b.xml").write_text("<annotations>" + entry.format(0, "s_x_OD.jpg", "") + "</annotations>", encoding="utf-8")
    rows = sources.read_annotations(spark, str(tmp_path))
    assert [(r["ord"], r["id"]) for r in rows.orderBy("ord").collect()] == [(1, 9), (2, 2), (3, 2), (4, 0)]
    got = {r["img_id"]: (r["tags"], r["excluded"]) for r in sync.annotations(rows.where("id > 0")).collect()}
    assert got == {"i1": ([], False), "i2": ([], True)}
    entries, invalid = sync.subset_entries(rows, 3)
    assert entries.count() == 0 and invalid.count() == 3  # the side isn't the last part of these names
    assert [r["patient_record_id"] for r in sync.subset_entries(rows, 4)[0].collect()] == ["s"]


def test_subset_join_matches_replaces_and_excludes(spark):
    entries = spark.createDataFrame([(1, "n1", "p", "left", "", 'None"a"'), (2, "n2", "p", "left", "", 'None"b"'), (3, "n3", "q", "right", "4", ""), (4, "n4", "z", "left", "", ""), (5, "n5", "q", "right", "", 'None"c"')], "ord long, name string, patient_record_id string, eye_side string, free_text string, label_text string")
    lookup = spark.createDataFrame([("p", "left", "10"), ("q", "right", "11"), ("r", "left", "12")], "patient_record_id string, eye_side string, img_id string")
    parameter = spark.createDataFrame([("10.0", 1, ["x"]), (" 10", 2, None), ("11", 3, ["x"]), ("12", 4, ["x"])], "img_id string, v int, tags array<string>")
    kept, unmatched, gone = sync.subset_parameter(entries, lookup, parameter)
    assert sorted((r["img_id"], r["v"], tuple(r["tags"])) for r in kept.collect()) == [("10", 1, ("b",)), ("10", 2, ("b",))]
    assert [r["name"] for r in unmatched.collect()] == ["n4"] and [r["img_id"] for r in gone.collect()] == ["11"]


def test_image_listing(spark, tmp_path):
    for name in ("a/1.JPG", "b/1.png", "b/2.jpg", "b/3.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = sources.list_images(spark, str(tmp_path))
    first, twice = sources.image_index(files)
    assert {r["stem"]: r["path"].rsplit("/", 2)[1] for r in first.collect()} == {"1": "a", "2": "b"} and [r["stem"] for r in twice.collect()] == ["1"]


def test_files_are_listed_as_spark_lists_them_but_by_tasks(spark, tmp_path):
    from quillspark.sources import files

    for name in ("1.jpg", "a b/%20 é.PNG", "a b/_hidden/2.jpg", "a b/.x/2.jpg", "_k=1/3.jpg", "a b/c/d/4.jpg", "a b/c/_5.jpg", "a b/c/.6.jpg", "a b/c/_k=7.jpg", "8.jpg._COPYING_", "_metadata", "a b/c/empty.jpg", "n.txt"):
        (tmp_path / "r" / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / "r" / name).write_bytes(b"" if "empty" in name else name.encode())
    (tmp_path / "r/nothing").mkdir()
    (tmp_path / "r/link.jpg").symlink_to(tmp_path / "r/1.jpg")
    (tmp_path / "r/folder").symlink_to(tmp_path / "r/a b/c")
    (tmp_path / "r/broken.jpg").symlink_to(tmp_path / "r/none")
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    root = f"file://{tmp_path}/r"
    for at in (root, f"{tmp_path}/r/", f"{root}/1.jpg", f"{root}/a*"):
        wanted = sorted(map(tuple, plain.load(at).select("path", "length").collect()))
        found = files.listed_files(spark, at)
        assert wanted and sorted(map(tuple, found.collect())) == wanted
    assert sorted(map(tuple, sources.list_images(spark, root).select("path").collect())) == sorted((p,) for p, _ in map(tuple, plain.load(root).select("path", "length").collect()) if p.lower().endswith(("jpg", "png")))
    assert "binaryFile" not in sources.list_images(spark, root)._jdf.queryExecution().toString()  # whose driver would hold every name
    with pytest.raises(FileNotFoundError):
        files.listed_files(spark, f"{tmp_path}/none")


def test_listed_names_hang_on_no_folder_above(spark, tmp_path, monkeypatch):
    from quillspark.plans import files

    monkeypatch.setattr(files, "work_path", lambda s, name: f"file://{tmp_path}/a/b/{name}-1/{name}")
    spark.createDataFrame([(1, "one"), (3, "three")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "uno")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    listed = files.QUERIES["file_listing"](spark, str(tmp_path))
    assert sorted(map(tuple, listed.collect())) == [("b/i1.PNG", "i1", 3), ("e/i1.jpeg", "i1", 3)]
    monkeypatch.setattr(files, "work_path", lambda s, name: f"file:{tmp_path}/a/c/{name}-2/{name}")
    assert list(map(tuple, files.QUERIES["image_index"](spark, str(tmp_path)).collect())) == [("i1", "b/i1.PNG")]


def test_run_states():
    assert resume.state_matches({"a": 1, "more": 2}, {"a": 1}) and not resume.state_matches({"a": 1}, {"a": 1, "b": 2})
    assert resume.output_mode(False, None, {}, False, False) == "fresh" and resume.output_mode(True, {"a": 1}, {"a": 1}, True, False) == "resume"
    with pytest.raises(FileExistsError):
        resume.output_mode(True, None, {}, False, False)
    with pytest.raises(ValueError):
        resume.output_mode(True, {"a": 2}, {"a": 1}, True, False)


def _book(path, sheets, shared=None):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{shared}</sst>')


def test_sheets_of_a_workbook(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>d</t></is></c></row>'
    body = '<row r="3"><c r="A3"><v>12.0</v></c><c r="B3"><v>0.5</v></c><c r="D3" t="b"><v>1</v></c><c r="E3"><v>9</v></c></row><row r="5"><c r="B5" t="s"><v>2</v></c></row><row r="6"><c r="A6"/></row>'
    _book(tmp_path / "x.xlsx", {"other": "", "disease_list": head + body}, "<si><t>img_id</t></si><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si><si><t> t\n </t></si>")
    rows = workbook.read_sheet(spark, str(tmp_path), "disease_list")
    assert rows.columns == ["path", "place", "img_id", "name", "d"]
    assert [tuple(r)[1:] for r in rows.orderBy("place").collect()] == [(2, "12", "0.5", "True"), (4, None, " t\n ", None)]
    assert workbook.read_sheet(spark, str(tmp_path), "other").count() == 0
    with pytest.raises(Exception, match="no such sheet"):
        workbook.read_sheet(spark, str(tmp_path), "absent").count()
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        workbook.read_sheet(spark, str(tmp_path / "none"), "other")


def test_a_written_workbook_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a<&>\x01 é" if k % 2 else None, k / 4) for k in range(10_000)], "k long, t string, x double")
    assert workbook.write_workbooks({"one": (rows, "k"), "two": (rows.limit(3), "k")}, str(tmp_path)) == 1
    back = workbook.read_sheet(spark, str(tmp_path), "one")
    got = {tuple(r) for r in back.select("place", "k", "t", "x").collect()}
    assert got == {(k + 1, str(k), "a<&> é" if k % 2 else None, str(k / 4)) for k in range(10_000)}
    assert workbook.read_sheet(spark, str(tmp_path), "two").count() == 3


def test_runs_are_published_whole_refused_resumed_and_replaced(spark, tmp_path):
    tasks = spark.range(10)
    output = runs.RunOutput(spark, f"file://{tmp_path}/run")
    by = lambda n: lambda rows: rows.select("id", F.lit(n).alias("by"))
    count = lambda: {n: sum(r["by"] == n for r in output.read().collect()) for n in (1, 2, 3)}
    assert output.read() is None and output.state() is None
    assert output.run(tasks.where("id < 4"), "id", by(1), {"beams": 1}) == 1
    with pytest.raises(FileExistsError):
        output.run(tasks, "id", by(2), {"beams": 1})
    with pytest.raises(ValueError):
        output.run(tasks, "id", by(2), {"beams": 2}, resume=True)
    with pytest.raises(ValueError):
        output.run(tasks, "id", by(2), {"beams": 1}, resume=True, overwrite=True)

    def fails(rows):
        return rows.select("id", F.when(F.col("id") < 8, 2).otherwise(F.raise_error(F.lit("lost"))).cast("int").alias("by"))

    with pytest.raises(Exception, match="lost"):
        output.run(tasks, "id", fails, {"beams": 1}, resume=True)
    assert count() == {1: 4, 2: 0, 3: 0}
    assert output.run(tasks, "id", by(2), {"beams": 1}, resume=True) == 2 and count() == {1: 4, 2: 6, 3: 0}
    old = output.read()
    assert output.run(tasks, "id", by(3), {"beams": 5}, overwrite=True) == 3 and count() == {1: 0, 2: 0, 3: 10}
    assert old.count() == 10 and output.state()["settings"] == {"beams": 5}
    assert output.run(tasks, "id", by(3), {"beams": 5}, overwrite=True) == 4 and output.read().count() == 10


def test_a_run_that_comes_second_does_not_count(spark, tmp_path):
    output = runs.RunOutput(spark, f"file://{tmp_path}/run")

    def meanwhile(rows):
        runs.RunOutput(spark, f"file://{tmp_path}/run").run(rows, "id", lambda r: r, {"a": 1})
        return rows.where("id < 0")

    with pytest.raises(runs.Taken):
        output.run(spark.range(5), "id", meanwhile, {"a": 1})
    assert output.read().count() == 5


REPORT = "性别: 男\n<table><tr><td>血管参数</td><td>右眼</td></tr></table>\n"


def test_streamed_reports_survive_replay_and_restart(spark, tmp_path):
    arrivals, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "stream")
    write = lambda name, rows: (arrivals / name).mkdir(parents=True) or (arrivals / name / "x.json").write_text("\n".join(json.dumps(dict(zip(("path", "md"), r, strict=True))) for r in rows))
    stream = lambda: spark.readStream.schema("path string, md string").json(f"{arrivals}/*")
    write("one", [("a", REPORT), ("b", " "), ("c", REPORT + "x"), ("c", REPORT), (None, REPORT)])

    def breaks(rows, key, md):
        reports.extract_reports(rows, key, md).write.mode("overwrite").parquet(f"{out}/rows/batch=0")
        raise RuntimeError("lost after the rows were written")

    with pytest.raises(Exception, match="lost"):
        reports.extract_arrivals(stream(), out, checkpoint, extract=breaks)
    reports.extract_arrivals(stream(), out, checkpoint)
    reports.extract_arrivals(stream(), out, checkpoint)  # nothing new
    write("two", [("c", "性别: 女"), ("d", REPORT), ("b", REPORT)])
    reports.extract_arrivals(stream(), out, checkpoint)
    got = {r["path"]: (r["sex"], r["batch"]) for r in reports.extracted(spark, out).collect()}
    assert got == {"a": ("男", 0), "c": ("男", 0), "d": ("男", 1)} and reports.extracted(spark, out).count() == 3
    batch = spark.createDataFrame([("c", "x"), ("d", REPORT), ("b", REPORT)], "path string, md string")
    reports.handle_batch(batch, 1, out, "path", "md")  # played again
    assert reports.extracted(spark, out).count() == 3
    assert {(r["key"], r["status"], r["batch"]) for r in reports.log_of(spark, out).collect()} == {("a", "ok", 0), ("b", "empty", 0), ("c", "ok", 0), ("d", "ok", 1)}


def test_a_batch_keeps_no_copy_of_its_texts(spark, tmp_path):
    rows = [("a", " "), ("a", "  x"), ("b", "\nx"), ("b", "  "), ("c", None), ("d", None), ("d", REPORT), ("e", "   "), ("e", " \t")]
    cached = []

    def extract(fresh, key, md):
        cached.append(fresh.storageLevel.useDisk or fresh.storageLevel.useMemory)
        return fresh.select(key, md)

    out = str(tmp_path / "out")
    reports.handle_batch(spark.createDataFrame(rows, "path string, md string"), 0, out, "path", "md", extract)
    assert cached == [False]
    assert {r["path"]: r["md"] for r in reports.extracted(spark, out).collect()} == {"b": "\nx", "d": REPORT, "e": " \t"}
    assert {(r["key"], r["status"]) for r in reports.log_of(spark, out).collect()} == {("a", "empty"), ("b", "ok"), ("c", "empty"), ("d", "ok"), ("e", "ok")}


def test_counts_of_the_pass_that_writes(spark, tmp_path):
    rows = spark.createDataFrame([(" 1",), ("2",), ("",), (None,), ("2",)], "key string")
    clean = spark.createDataFrame([("2",), ("2",), (" ",), ("9",)], "k string")
    counts = split.write_kept_and_removed(rows, clean, "key", str(tmp_path / "x"), "k")
    assert counts == {"rows": 5, "kept": 2, "removed": 3, "clean_keys": 2}
    assert {r["key"] for r in spark.read.schema("key string, kept boolean").parquet(str(tmp_path / "x")).where("kept").collect()} == {"2"}
