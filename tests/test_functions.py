"""Scalar functions and scores against plain Python statements of them."""

import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dims, structure, text, udf
from quillspark.operators import extract, gold, metrics, parse, rank, report, reward, score, split, tail
from quillspark.session import work_path

REPORT = "描述：杯盘比为0.3。下方视网膜可见散在出血；黄斑处可见硬性渗出。静脉迂曲扩张，鼻上方、颞下方视网膜沿血管放射状出血。可见12处动静脉交叉压迫点。视盘可见出血。\r\n\n初步诊断： 疑似青光眼、黄斑裂孔 、"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def test_normalisation_agrees_with_the_full_form(spark):
    for t in (REPORT, "", None, "a\r\rb ", "　（x）　\n\n；"):
        assert one(spark, t, text.normalized) == udf.plain_normalized(t)
    assert one(spark, "a…b", udf.nfkc_normalized) == "a...b"


def test_sections_labels_format(spark):
    norm = udf.plain_normalized(REPORT)
    assert one(spark, norm, lambda c: text.section(c, "描述")).startswith("杯盘比为0.3.")
    assert one(spark, norm, lambda c: text.label_set(text.section(c, "初步诊断"))) == sorted(["疑似青光眼", "黄斑裂孔"])
    assert one(spark, norm, text.has_report_format) is True
    assert one(spark, "描述:\n初步诊断:a", lambda c: text.section(c, "描述")) == "初步诊断:a"  # a blank section takes the next line
    assert one(spark, "", text.has_report_format) is False


def test_sentences_keep_decimal_points(spark):
    assert one(spark, "a0.5b. c ;, d.e", text.sentences_of) == ["a0.5b", "c", "d", "e"]


def test_structure(spark):
    r = parse.parsed(spark.createDataFrame([(REPORT,), (None,)], "x string"), "x", "p_").collect()
    assert r[0]["p_ratio"] == 0.3
    assert set(r[0]["p_findings"]) == {"视网膜:出血", "黄斑处:硬性渗出", "视网膜:沿血管放射状出血", "血管:动静脉交叉压迫点", "视盘:出血"}
    assert set(r[0]["p_places"]) == {"下方", "鼻上方", "颞下方"} and [tuple(b) for b in r[0]["p_buckets"]] == [("视网膜|出血|下方", "散在")]
    assert r[1]["p_findings"] == [] and r[1]["p_ratio"] is None


def test_patterns_don_t_overlap():
    patterns = [dims.RATIO_PATTERN, dims.COUNTED_PATTERN, dims.MACULA_PATTERN, dims.OCCLUSION_PATTERN, dims.CROSSING_PATTERN]
    assert not [s for s in dims.DIRECT_FINDINGS if any(re.match(p, s) for p in patterns)]


def test_scores_of_equal_and_of_empty_reports(spark):
    rows = spark.createDataFrame([(REPORT, REPORT), ("", REPORT), (REPORT, "")], "prediction string, reference string")
    a, b, c = score.score_reports(rows).collect()
    assert [a[m] for m in score.MEASURES] == [1, 1, 1, 1, 1, 1, 0, 1]
    assert (b["description_cdr_abs_error"], b["description_cdr_tol_hit"], b["format_correct"]) == (1, 0, 0)
    assert (c["description_cdr_abs_error"], c["description_cdr_tol_hit"], c["description_count_bucket_acc"]) == (0, 0, 0)


def test_ratio_tolerance_is_of_doubles(spark):
    r = spark.range(1).select(score.ratio_hit(F.lit(0.4), F.lit(0.3)).alias("x"), score.ratio_hit(F.lit(0.3), F.lit(0.2)).alias("y")).first()
    assert (r["x"], r["y"]) == (float(abs(0.4 - 0.3) <= 0.1), float(abs(0.3 - 0.2) <= 0.1))


def test_tags(spark):
    assert one(spark, 'None"杯盘比偏大", , "糖尿病视网膜病变增殖期,", "杯盘比偏大",', text.tag_list) == ["杯盘比偏大", "糖尿病视网膜病变增殖期"]  # spellings are looked up before commas go
    assert one(spark, "a_b_OD_0807.jpg", text.image_id) == "0807" and one(spark, "plain", text.image_id) == "plain"
    assert one(spark, "12_x_y_OS.jpg", text.record_of)["side"] == "left" and one(spark, "12_OS.jpg", text.record_of) is None
    assert one(spark, " 123.0", text.identifier) == "123"
    got = spark.range(1).select(text.in_diagnosis_order(F.array(*map(F.lit, ["x", "黄斑裂孔", "y", "疑似青光眼", "x"]))).alias("y")).first()["y"]
    assert got == ["疑似青光眼", "黄斑裂孔", "x", "y"]
    got = spark.range(1).select(text.sided_tags(F.array(*map(F.lit, ["a，左眼", "b，右眼", "c，双眼", "未见明显异常", "d"])), F.lit("left")).alias("y")).first()["y"]
    assert got == ["a", "c"]


def test_python_formats_and_lists(spark):
    rows = spark.createDataFrame([(v,) for v in (0.25, 0.35, 5e-7, 2.5)], "x double")
    assert [r["y"] for r in rows.select(udf.fixed(1)("x").alias("y")).collect()] == ["0.2", "0.3", "0.0", "2.5"]
    assert udf.plain_list("['a', \"b\"]") == ["a", "b"] and udf.plain_list("a b") == ["a b"] and udf.plain_list("nan") == [] and udf.plain_list("(1, 2)") == ["1", "2"]


def test_safe_numbers(spark):
    rows = spark.createDataFrame([("-3.9",), ("x",), (None,), ("nan",), ("1e99",), ("7",)], "x string")
    assert [r["y"] for r in rows.select(text.safe_int(F.col("x")).alias("y")).collect()] == [-3, 0, 0, 0, 0, 7]


def _quota(n, vr, tr):
    if n <= 1:
        return n, 0, 0
    v, t = round(n * vr), round(n * tr)
    if n >= 10:
        v, t = max(v, vr > 0), max(t, tr > 0)
    while v + t > n - 1:
        if v >= t and v > 0:
            v -= 1
        else:
            t -= 1
    return n - v - t, v, t


@pytest.mark.parametrize("ratios", [(0.02, 0.02), (0.1, 0.05), (0.45, 0.5), (0.0, 0.3), (0.49, 0.5)])
def test_quotas(spark, ratios):
    q = split.quota(F.col("id"), *ratios)
    rows = spark.range(0, 300).select("id", *[c.alias(k) for k, c in q.items()]).collect()
    assert [(r["train"], r["val"], r["test"]) for r in rows] == [_quota(r["id"], *ratios) for r in rows]


def test_quota_outcomes_equal_a_simulation(spark):
    ok = lambda d, i: d % 13 != 0 and (i == 0 if d % 11 == 0 else (d * 31 + i * 17) % 10 < 6)
    levels = list(dims.POLICIES)
    rows = spark.range(0, 120).select("id", F.element_at(F.array(*map(F.lit, levels)), (F.col("id") % 4 + 1).cast("int")).alias("level"))
    passes = F.when(F.col("id") % 13 == 0, F.lit(False)).when(F.col("id") % 11 == 0, F.col("attempt") == 0).otherwise((F.col("id") * 31 + F.col("attempt") * 17) % 10 < 6)
    got = {(r["id"], r["attempt"]): r["event"] for r in tail.quota_outcomes(tail.attempts(rows, "id", "level"), "id", passes).collect()}
    want = {}
    for d in range(120):
        total, batch, _ = dims.POLICIES[levels[d % 4]]
        target, made, taken = total - 1, 0, 0
        while target and batch and taken < target and made < max(target, batch) * 8:
            for _ in range(min(batch, max(target, batch) * 8 - made)):
                good = ok(d, made)
                want[d, made] = "accepted" if good and taken < target else "unused_accepted" if good else "rejected"
                taken += good and taken < target
                made += 1
    assert got == want


def test_split_covers_and_is_stable(spark):
    rows = spark.range(0, 500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    a = split.stratified_split(rows, "g", "k", 0.1, 0.1).collect()
    b = split.stratified_split(rows.repartition(7), "g", "k", 0.1, 0.1, salts=1).collect()
    assert len(a) == 500 and sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_merged_places():
    assert dims.PLACES_BY_MASK[15] == "上方、下方" and dims.PLACES_BY_MASK[5] == "鼻侧" and dims.PLACES_BY_MASK[7] == "下方、鼻上方"


def test_grids(spark):
    html = "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td></tr><tr><td>d（1）</td></tr></table>"
    grid = lambda h: extract.grids(spark.createDataFrame([(h,)], "html string")).first()["grid"]
    assert grid(html) == [["a", "b", "b"], ["a", "c", ""], ["d(1)", "", ""]]
    assert grid("") == [] and grid(None) == []
    rows = spark.createDataFrame([("r", "性别：女 \n![](x)\n视盘面积分析\n<table><tr><td>视盘面积（mm<sup>2</sup>）</td><td>1</td></tr><tr><td>视杯/视盘面积比</td><td>2</td></tr></table>")], "path string, md string")
    assert rows.select(extract.basic_info(F.col("md"))["性别"].alias("y")).first()["y"] == "女"
    cells = extract.cells_by_schema(extract.by_schema(extract.report_tables(rows), "path"), "path").where("column = '右眼'").collect()
    assert {(c["row"], c["value"]) for c in cells} == {("视盘面积(mm²)", "1"), ("视杯/视盘面积比", "2"), ("视杯面积(mm²)", None), ("盘沿面积(mm²)", None)}


def test_ranking_puts_missing_metrics_last(spark):
    rows = spark.createDataFrame([("checkpoint-10", None), ("checkpoint-20", 0.5), ("checkpoint-30", 0.5), ("x", 0.1)], "name string, f1 double").withColumn("step", rank.checkpoint_step(F.col("name")))
    assert [r["name"] for r in rank.ranked(rows, ["f1"]).orderBy("rank").collect()] == ["checkpoint-20", "checkpoint-30", "x", "checkpoint-10"]
    assert rank.best(rows, "f1").first()["name"] == "checkpoint-20"


def test_report_defaults(spark):
    names = [p + q for p, *_ in dims.COUNTED for q in dims.QUADRANTS] + [dims.LASER + q for q in dims.QUADRANTS] + [p + "r2" for p, _, m, *_ in dims.COUNTED if m]
    names += ["discbloodnumber", "ratioatrophymaxwidth", "arteriovenouscrossingnumber", "atrophicfocinumber", "lacquercracknumber", "rnfldarea"]
    rows = spark.range(1).select(F.lit("i").alias("img_id"), F.lit(0.4).alias("ratiocdv"), F.lit(None).cast("array<string>").alias("tags"), F.lit("").alias("institution_name"), F.lit("").alias("img_path"), *[F.lit(None).cast("double").alias(n) for n in names])
    assert report.report_text(rows).first()["description"] == "描述：杯盘比为0.4。\n初步诊断：未见明显异常表征"


def test_grid_cells_and_spans():
    rows = udf.table_grid("<table><tr><td rowspan=2>a<b>b</b></td><td colspan=300>c</td></tr><tr><td>10<sup>3</sup> &amp;lt;</td></tr><tr></tr><tr><td> </td></tr></table>")
    assert rows[0] == ["a b", *["c"] * 300] and rows[1] == ["a b", "10 3 <"] and len(rows) == 2
    # A span that isn't next to the row's end waits for a row that reaches it.
    assert udf.table_grid("<tr><td>x</td><td>y</td><td rowspan=2>z</td></tr><tr><td>1</td></tr><tr><td>1</td><td>2</td></tr>") == [["x", "y", "z"], ["1"], ["1", "2", "z"]]
    assert udf.table_grid('<tr><td colspan="²">x</td><td rowspan="٣">y</td><td colspan="-2">z</td></tr>') == [["x", "y", "z"]]
    assert [len(r) for r in udf.table_grid('<tr><td colspan="1000000000">x</td><td colspan=99999999999999999999>y</td></tr>')] == [2000]
    assert udf.table_grid(None) == [] and udf.table_grid("<table>") == []


def test_cell_text(spark):
    said = {"最大面积(m²) 3 m²": "最大面积(mm²) 3 m²", "最大面积( 3 m²": "最大面积(3 mm²", "（ MM<sup> 2 </sup> ）": "(mm²)", "3 mm 2 x": "3 mm²x", "m 2a m 2": "m 2a m²", "\u3000 虎纹斑\u00a0\n x ": "豹纹斑 x", "µ": "μ"}
    got = spark.createDataFrame([(k, v) for k, v in said.items()], "raw string, want string").withColumn("got", text.cell_text(F.col("raw"))).collect()
    assert {r["raw"]: r["got"] for r in got} == said


def test_columns_by_aliases():
    assert text.column_by_aliases(["x", "Image ID", "imgid"], ["img_id", "image_id"]) == "imgid"
    assert text.column_by_aliases(["x"], ["y"], required=False) is None
    with pytest.raises(KeyError):
        text.column_by_aliases(["x"], ["y"])


def test_exudate_forms_and_header_rows(spark):
    rows = [("none", 0, "出血渗出", [["x", "1"]]), ("short", 0, "出血渗出", [["出血", "1"]]), ("wide", 0, "出血渗出", [["出血", *map(str, range(14))]]), ("head", 0, "盘沿分析", [["I区内容", "右眼", "左眼"], ["S区", "3"]])]
    found = extract.by_schema(spark.createDataFrame(rows, "k string, nth int, type string, grid array<array<string>>"), "k").collect()
    schema = {r["k"]: r["schema"] for r in found}
    assert schema == {"none": None, "short": "EXUDATION_SUMMARY", "wide": "EXUDATION_QUADRANT", "head": "盘沿分析"}
    warned = {(r["k"], r["row"]): r["warning"] for r in found}
    assert warned["none", None] == dims.NO_EXUDATION_ROW and warned["short", "渗出"] == dims.NO_ROW + "渗出" and warned["short", "出血"] is None
    assert warned["head", "I区"] is None and warned["head", "S区"] is None and warned["head", "T区"] == dims.NO_ROW + "T区"


def test_strict_zip_and_early_stop(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, 5), (3, 6)], "k int, y int")
    with pytest.raises(Exception, match="one-to-one"):
        split.zipped(left, right, "k").collect()
    with pytest.raises(Exception, match="one-to-one"):
        split.zipped(left, right, "k").count()
    with pytest.raises(Exception, match="one-to-one"):
        split.zipped(left, right, "k").select("y").collect()
    assert split.zipped(left, left.withColumnRenamed("x", "y"), "k").count() == 2
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else "t") for k in range(30)], "k int, text string")
    got = split.load_counters(rows, "text", F.col("k") % 2 == 1, "k", 4).first()
    assert tuple(got) == (12, 4, 4, 4)


def test_metric_predicates():
    assert not rank.greater_is_better("eval_description_cdr_mae") and rank.greater_is_better("train_loss")
    assert rank.runs_structured("eval_loss", None) is False and rank.runs_structured("eval_loss", True) and rank.structured_metric("eval_diagnosis_micro_f1")


def _content(c):
    if isinstance(c, dict):
        return str(c["text"]).strip() if "text" in c else ""
    if isinstance(c, list):
        parts = [str(x.get("text", "")).strip() if isinstance(x, dict) and x.get("type") == "text" else x.strip() if isinstance(x, str) else "" for x in c]
        return "\n".join(p for p in parts if p)
    return str(c).strip()


def _completion(c):
    if isinstance(c, dict):
        return _content(c.get("content", ""))
    if isinstance(c, list):
        return "\n".join(p for p in map(_completion, c) if p)
    return str(c).strip()


def test_message_texts_of_mixed_shapes(spark):
    parts = [{"type": "text", "text": " f "}, " g ", {"type": "image"}, 5, "  ", {"type": "text", "text": 7}, [" no "]]
    shapes = [" a ", {"content": " b "}, [{"content": " c "}, " d ", [["e ", {"content": parts}]]], None, True, False, 1.5, 10, {"x": 1}, {"content": None}, {"content": {"text": " h\n"}}, {"content": {"t": 1}}, {"content": []}, [], ["", [" "]], [[[[[["deep"]]]]]], {"content": " \u3000x\u3000"}, {"content": parts}]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(shapes)] + [(99, None)], "k int, j string").withColumn("v", F.parse_json("j"))
    got = {r["k"]: r["t"] for r in rows.select("k", reward.message_text(F.col("v")).alias("t")).collect()}
    assert got.pop(99) is None and got == {k: _completion(v) for k, v in enumerate(shapes)}
    with pytest.raises(Exception, match="lists in one another"):
        rows.where("k = 15").select(reward.message_text(F.col("v"), depth=3)).collect()


@pytest.mark.parametrize("few", [3, 50, 10_000])
def test_exact_median(spark, few):
    rng = random.Random(few)
    tables = [[], [None], [float("nan"), None], [2.0], [1.0, 2.0], [5.0] * 400, [1.0] * 300 + [2.0] * 300, [1.0] * 301 + [2.0] * 300, [float(k) for k in range(999)], [rng.choice([1e300, -1e300, 0.0, 1e-300, 3.0]) for _ in range(500)], [rng.gauss(0, 1) for _ in range(1000)] + [None] * 10, [10.0**k for k in range(-100, 100)]]
    for values in tables:
        kept = [v for v in values if v is not None and v == v]
        found = metrics.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v", few)
        assert found == (statistics.median(kept) if kept else None)


def test_a_record_with_both_losses_is_an_evaluation(spark):
    rows = spark.createDataFrame([(0, 1, None, 0.5, None), (1, 2, 0.25, 0.4, 0.9), (2, None, 1.0, 0.1, None), (3, 3, 2.0, None, None)], "i int, step int, epoch double, loss double, eval_loss double")
    assert sorted(tuple(r) for r in rank.loss_series(rows, "i", epoch="epoch").collect()) == [(0, 1, 0.0, "train", 0.5), (1, 2, 0.25, "eval", 0.9)]


def test_one_decimal_is_exact(spark):
    rng = random.Random(1)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 0.949999999999, 0.95, 1.0, 2.5, 1e-320, 123456.25, 2.0**47 + 0.25] + [rng.random() * 10.0 ** rng.randint(-3, 12) for _ in range(300)] + [k / 20 for k in range(200)] + [k / 40 for k in range(200)]
    rows = spark.createDataFrame([(v,) for x in values for v in (x, -x)] + [(None,)], "v double")
    assert {r["v"]: r["t"] for r in rows.select("v", text.one_decimal(F.col("v")).alias("t")).collect()} == {v: f"{v or 0:.1f}" for x in values for v in (x, -x)} | {None: "0.0"}


def test_stored_gold_is_met_without_an_exchange(spark):
    truths = spark.createDataFrame([(k, f"描述：杯盘比为0.{k % 9}。\n初步诊断：疑似青光眼") for k in range(50)] + [(None, "x")], "key long, truth string")
    stored = gold.StoredGold(spark, work_path(spark, "gold"))
    stored.write(truths, "truth", 3)
    again = gold.StoredGold(spark, stored.root)
    texts = spark.createDataFrame([(k, t) for k in range(60) for t in ("描述：杯盘比为0.4。\n初步诊断：疑似青光眼", "描述：杯盘比为0.4。\n初步诊断：疑似青光眼", "x")], "key long, text string")
    found = again.scored(texts, "text")
    plain = reward.scored_against_gold(reward.gold_fields(truths, "truth").join(texts.distinct(), "key"), "text")
    names = ["key", "text", *[c for c in found.columns if c not in ("key", "text", "times")]]
    assert sorted(map(tuple, found.select(names).collect())) == sorted(map(tuple, plain.select(names).collect()))
    assert {r["times"] for r in found.where("text <> 'x'").collect()} == {2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("gold_") - 2000 :]
    assert "Bucketed: true" in plan and "Exchange" not in side[side.index("FileScan") - 400 :]
    stored.close()
    again.close()


def test_label_metrics_of_pairs(spark):
    rows = [(["a", "b"], ["a"]), (["a", "b"], ["a"]), ([], ["c"]), (["a"], []), ([], [])]
    df = spark.createDataFrame(rows, "pred_diagnosis_labels array<string>, ref_diagnosis_labels array<string>")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"], r["accuracy"]) for r in metrics.label_metrics(df).collect()}
    assert got == {"a": (2, 1, 0, 0.8), "b": (0, 2, 0, 0.6), "c": (0, 0, 1, 0.8)}


def test_rewards_are_scored_in_place(spark):
    text = "描述：杯盘比为0.3。\n初步诊断：青光眼"
    rows = reward.rewards(spark.createDataFrame([(1, text, text), (2, text, text), (3, "", text), (4, None, text)], "k long, p string, r string"), "k", "p", "r")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r["k"]: (r["format_reward"], r["description_reward"], r["diagnosis_reward"]) for r in rows.collect()} == {1: (1.0, 1.0, 1.0), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.75, 0.0), 4: (0.0, 0.75, 0.0)}


def test_sentences_are_taken_out_by_kind(spark):
    odd = "描述：杯盘比为。0.3；上方、鼻侧视网膜可见散在出血 ,。视网膜可见视网膜内微血管异常；上方、鼻侧视网膜可见大量出血。 , 。黄斑处可见出血。杯盘比为 0.4。可见3处动静脉交叉压迫点；静脉迂曲扩张，下方视网膜沿血管放射状出血。杯盘比偏大。x杯盘比偏大。杯盘比为0.5\n初步诊断：乙、甲"
    rows = parse.parsed(spark.createDataFrame([(odd,)], "x string"), "x", "p_")
    assert "RLIKE(lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()  # no sentence is matched on its own
    r = rows.first()
    assert r["p_findings"] == sorted(["视网膜:出血", "视网膜:视网膜内微血管异常", "黄斑处:出血", "血管:动静脉交叉压迫点", "视网膜:沿血管放射状出血", "视盘:杯盘比偏大"])
    assert r["p_places"] == sorted(["上方", "鼻侧", "下方"]) and r["p_labels"] == ["乙", "甲"] and r["p_ratio"] == 0.5
    assert [tuple(x) for x in r["p_buckets"]] == [("视网膜|出血|上方、鼻侧", "大量"), ("视网膜|视网膜内微血管异常|无位置", "default")]


def test_plain_markup_needs_no_parser(monkeypatch):
    pieces = ["<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<td rowspan=2>", '<td colspan="3">', "<td colspan=0>", "<sup>2</sup>", "<br>", "a ", " ", "&amp;lt;", "&#65", ">", "<TD>", "<!--x-->", "<p>", "<"]
    rng, parsed = random.Random(3), udf._parsed

    def told(rows, source):
        monkeypatch.setattr(udf, "_raw_rows", rows)
        try:
            return udf.table_grid(source)
        except IndexError:  # text between a row's begin and its first cell
            return None

    plain = udf._raw_rows
    for _ in range(3000):
        source = "<table>" + "".join(rng.choice(pieces[: 16 if rng.random() < 0.8 else None]) for _ in range(rng.randrange(30))) + "</table>"
        assert told(plain, source) == told(parsed, source), source
    monkeypatch.setattr(udf, "_raw_rows", plain)
    monkeypatch.setattr(udf, "_parsed", lambda source: pytest.fail("parsed"))
    assert udf.table_grid("<table><tr><td rowspan=2>m<sup>2</sup></td><td>a</td></tr><tr><td>&amp;b</td></tr></table>") == [["m 2", "a"], ["m 2", "&b"]]


def test_fields_are_taken_from_the_whole_text(spark):
    md = " ![](a.png) \r\n性别: 女 \n![](b) x\n# 糖尿病性视网膜病变分析 y\n\n 未见 \n\t复查\n 医师: 甲\n## 评估结果\n评估结果\nOD(右眼): a\n 评估结果\n b\n# c\nOS(左眼): d"
    rows = spark.createDataFrame([(1, md), (2, None)], "k long, md string")
    assert one(spark, md, extract.without_images).split("\n")[:2] == ["性别: 女", "![](b) x"]
    found = extract.report_fields(rows, "k")
    assert {r["k"]: (r["sex"], r["analysis"], r["od"], r["os"]) for r in found.collect()} == {1: ("女", "未见 复查", "OD(右眼): a b", None), 2: (None, None, None, None)}
    # Lines aren't taken one by one.
    whole = rows.select(extract.without_images(F.col("md")), extract.analysis_text(F.col("md")))
    assert "lambda" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_are_bounded_in_rows(spark, tmp_path, monkeypatch):
    from quillspark.plans import bindings, markup

    spark.range(100).selectExpr("id AS o_orderkey", "id AS o_custkey", "'x' AS o_orderdate", "'F' AS o_orderstatus").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(bindings, "PIECE_ROWS", 10)
    for rows in (markup.reports(spark, str(tmp_path)), bindings.parameter(spark, str(tmp_path))):
        assert rows.rdd.getNumPartitions() == 10 and max(rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) < 20


def test_strip_looks_at_the_ends_only(spark):
    signs = [chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000] + ["﻿", "\U0001f600", ""]
    rows = spark.createDataFrame([(a + b + x + "\ta" + x + b + a,) for x in signs for a, b in (("", ""), (" \n", ""), ("　", "\r"))] + [("",), (" \r\n",), (None,)], "x string")
    by_pattern = F.regexp_replace("x", r"(?U)^\s+|\s+$", "")
    assert rows.where(~text.strip(F.col("x")).eqNullSafe(by_pattern)).count() == 0
    lines = F.regexp_replace(text.or_empty(F.col("x")), "\r\n?", "\n")
    assert rows.where(text.unified_lines(F.col("x")) != lines).count() == 0
    assert "regexp" not in rows.select(text.normalized(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()


def test_types_move_places_only(spark):
    md = "盘沿分析 \r\n![](a.png)\n\n甲\n<table><tr><td>x</td></tr></table>乙\n<TABLE><tr><td> 内容</td><td>y</td></tr>" + "".join(f"<tr><td>{z}区</td><td>1</td></tr>" for z in "ISNT") + "</TABLE>\n<table><tr><td>q"
    rows = spark.createDataFrame([(1, md), (2, None), (3, "a")], "k long, md string")
    assert [(r["nth"], r["before"]) for r in extract.tables_of(rows, "k").orderBy("nth").collect()] == [(0, ["盘沿分析", "甲"]), (1, ["盘沿分析", "甲", "乙"])]
    found = extract.report_tables(rows, "k")
    assert [(r["k"], r["type"], r["nth"], r["grid"][0], r["before"][-1]) for r in found.collect()] == [(1, "盘沿分析", 1, ["内容", "y"], "乙")]
    # Neither grids nor lines meet by key if places alone are asked for, and none is sorted.
    plan = found.select("k", "type", "nth")._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan


def test_bare_rows_and_known_headers_are_read_at_once(monkeypatch):
    head, row = '<table><tr><td rowspan=2>a</td><td colspan="2">b</td></tr><tr><th>c</th><td>d</td></tr>', "<tr><td> x>&amp;lt;</td><td></td><td>1</td></tr><tr><td> </td></tr>"
    want = [["a", "b", "b"], ["a", "c", "d"], ["x><", "", "1"]]
    assert udf.table_grid(head + row + "</table>") == want
    monkeypatch.setattr(udf, "_bracketed", lambda source: pytest.fail("read by brackets"))
    monkeypatch.setattr(udf, "_parsed", lambda source: pytest.fail("parsed"))
    assert udf.table_grid(head + row * 2 + "</table>") == [*want, want[2]]


def test_scoring_reads_each_report_once_without_lambdas(spark):
    rows = spark.createDataFrame([(1, REPORT, REPORT)], "k long, prediction string, reference string")
    plan = score.flat_rows(score.score_reports(rows), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "lambda" not in plan and "regexp" not in plan
    other = parse.parsed(rows, "prediction", "p_")._jdf.queryExecution().executedPlan().toString()
    assert other.count("ArrowEvalPython [") == 1 and "lambda" not in other


def test_plain_structure_equals_the_columns(spark):
    rng = random.Random(11)
    ends = ["\n", "\r\n", "\r", "\x85", " ", "\x1c", "　", " ", "。", "；", ".", ";", ",", "0", "0.5", "、"]
    words = ["描述", "描述：", "描述 :", "初步诊断：", "初步诊断", "：", "杯盘比为0.5", "上方视网膜可见出血", "杯盘比偏大", "甲", "“乙”"]
    odd = ["", *("".join(rng.choice(words + ends) for _ in range(rng.randint(1, 14))) for _ in range(1500))]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").withColumn("n", text.normalized(F.col("x")))
    sections = [text.section(F.col("n"), label) for label in ("描述", "初步诊断")]
    native = rows.select("x", "n", *sections, text.label_set(sections[1]), text.has_report_format(F.col("n"))).collect()
    for x, norm, description, diagnosis, labels, good in native:
        found = structure.report(x)
        assert ("\n".join(found[0]), *found[1:5]) == (norm, description, diagnosis, labels, good), x


def test_structure_of_what_stands_around_decimal_points():
    found = structure.described("杯盘比为0.5.上方视网膜可见出血;杯盘比为 0.25 ,.杯盘比为0.7.5.视盘旁可见脉络膜萎缩弧.3.上方视网膜可见大量出血")
    assert found[3] == 0.25 and found[2] == {"视网膜|出血|上方": "大量"}  # the last bucket and the last ratio that is one
    assert structure._listed(found[0], structure.FINDINGS) == sorted(["视网膜:出血", "视盘旁:脉络膜萎缩弧"])
    assert structure.described("杯盘比为0.5")[3] == 0.5 and structure.described("杯盘比为5.;")[3] == 5.0 and structure.described("")[2:] == ({}, None)


def test_scores_of_text_that_isn_t_unicode(spark):
    rows = spark.createDataFrame([(bytearray(REPORT.encode() + b"\xff"), REPORT)], "b binary, reference string").selectExpr("CAST(b AS STRING) AS prediction", "reference")
    r = score.score_reports(rows.repartition(1)).first()
    assert r["format_correct"] == 1 and r["diagnosis_exact_set_acc"] == 0


def test_report_text_is_worded_in_one_function(spark):
    names = [p + q for p in [p for p, *_ in dims.COUNTED] + [dims.LASER] for q in dims.QUADRANTS] + [p + "r2" for p, _, macula, *_ in dims.COUNTED if macula]
    names += ["discbloodnumber", "ratioatrophymaxwidth", "arteriovenouscrossingnumber", "atrophicfocinumber", "lacquercracknumber", "rnfldarea"]
    own = {dims.LASER + "inferiornasal": "1", "bloodnumberdistribution_superiornasal": "60", "bloodnumberdistribution_r2": "1", "arteriovenouscrossingnumber": "2.9", "discbloodnumber": "nan", "drusennumberdistribution_r2": " 3 "}
    rows = [("a", 0.25, ["视网膜激光斑", "（未知）", "动脉阻塞"]), ("b", None, ["中央静脉阻塞", "分支 静脉阻塞", None, "黄斑前膜II期", "黄斑前膜I期"]), ("c", -0.04, None)]
    df = spark.createDataFrame([(i, r, t, "x", "p", *[own.get(n) for n in names]) for i, r, t in rows], "img_id string, ratiocdv double, tags array<string>, institution_name string, img_path string, " + ", ".join(f"{n} string" for n in names))
    found = report.report_text(df)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    retina, vessel = "鼻上方视网膜可见大量出血。", "可见2处动静脉交叉压迫点。"
    assert {r["img_id"]: r["description"] for r in found.collect()} == {
        "a": f"描述：杯盘比为0.2。{vessel}黄斑处可见出血。黄斑处可见玻璃膜疣。{retina}眼底可见激光斑。视网膜苍白色混浊。\n初步诊断：动脉阻塞",
        "b": f"描述：杯盘比为0.0。{vessel}静脉迂曲扩张，鼻上方视网膜沿血管放射状出血。黄斑处可见玻璃膜疣。黄斑区可见金箔样反光，放射状皱褶，小血管迂曲。眼底可见激光斑。\n初步诊断：中央静脉阻塞、分支静脉阻塞、黄斑前膜I期、黄斑前膜II期",
        "c": f"描述：杯盘比为-0.0。{vessel}黄斑处可见出血。黄斑处可见玻璃膜疣。{retina}眼底可见激光斑。\n初步诊断：未见明显异常表征",
    }


def test_completions_meet_gold_in_one_function(spark):
    said = "描述：上方视网膜可见大量出血。\n初步诊断：甲"
    buckets = ['{"视网膜|出血|上方": "大量"}', '{"视网膜|出血|上方":"大量", "a": 1}', '{"视网膜|出血|上方": "\\u5927量"}', "{}", " ", "[1]", None]
    of = ("array('甲') AS gold_diagnosis_labels", "'' AS gold_description", "array('视网膜:出血', null, 'z', 'z') AS gold_findings", "array('上方') AS gold_locations", "b AS gold_bucket_map_json", "CAST('NaN' AS double) AS gold_cdr_value")
    rows = spark.createDataFrame([(i, b, said) for i, b in enumerate(buckets)], "i int, b string, c string").selectExpr("i", "c", *of)
    found = reward.scored_against_gold(rows, "c")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "array_intersect" not in plan
    got = {r["i"]: r for r in found.collect()}
    assert [got[k]["description_count_bucket_acc"] for k in range(len(buckets))] == [1.0, 0.5, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert (got[0]["description_finding_set_f1"], got[0]["description_location_f1"], got[0]["diagnosis_exact_set_acc"], got[0]["description_cdr_abs_error"], got[0]["description_cdr_tol_hit"]) == (0.5, 1.0, 1.0, 1.0, 0.0)
