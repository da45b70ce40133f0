"""Queries over splits, rarity, augmentation, preferences, checkpoints, kernels and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import labels_of
from ..operators import numeric, prefer, rank, resume, split, tail
from ..session import work_path
from .bindings import pairs
from .reports import SCORE_CTES, r9


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


# Splits and rarity over documents -------------------------------------------------------------------------------------

RECORD_SQL = "SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS img_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE concat(lang, '、', source) END AS diagnosis FROM documents"


def records(s, d):
    """B3: one record a document, with a diagnosis of one or two labels."""
    return table(s, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("img_id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.concat_ws("、", "lang", "source")).alias("diagnosis"))


def labels():
    return labels_of(F.col("diagnosis"))


def divided(s, d):
    return split.stratified_split(records(s, d), "diagnosis", "img_id", 0.1, 0.05)


def vocabulary(s, d):
    return split.label_vocabulary(records(s, d), labels())


def scores(s, d):
    return tail.tail_scores(records(s, d), "ord", labels())


_split_sql = f"""rec AS ({RECORD_SQL}), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY md5(concat(img_id, '|', '42')), img_id) AS p, count(*) OVER (PARTITION BY diagnosis) AS n FROM rec
), q0 AS (
  SELECT DISTINCT diagnosis, n, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT) AS v0, CAST(round_even(n * 0.05::DOUBLE, 0) AS BIGINT) AS t0 FROM ranked
), q1 AS (SELECT diagnosis, n, CASE WHEN n <= 1 THEN 0 WHEN n >= 10 AND v0 = 0 THEN 1 ELSE v0 END AS val, CASE WHEN n <= 1 THEN 0 WHEN n >= 10 AND t0 = 0 THEN 1 ELSE t0 END AS test FROM q0
), done AS (
  SELECT r.*, CASE WHEN p <= r.n - val - test THEN 'train' WHEN p <= r.n - test THEN 'val' ELSE 'test' END AS split FROM ranked r JOIN q1 USING (diagnosis)
)"""
_label_sql = f"""rec AS ({RECORD_SQL}), lab AS (SELECT DISTINCT ord, label FROM (SELECT ord, unnest(string_split(diagnosis, '、')) AS label FROM rec))"""
_support_sql = _split_sql + ", lab AS (SELECT DISTINCT ord, split, label FROM (SELECT ord, split, unnest(string_split(diagnosis, '、')) AS label FROM done)), support AS (SELECT label, count(*) FILTER (split = 'train') AS support FROM lab GROUP BY label)"
_tail_sql = _label_sql + f""", rare AS (SELECT label, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, count(*))) AS r FROM lab GROUP BY label
), single AS (SELECT ord, avg(r) AS single FROM lab JOIN rare USING (label) GROUP BY ord
), combos AS (SELECT ord, string_agg(label, '、' ORDER BY label) AS c FROM lab GROUP BY ord
), counted AS (SELECT c, count(*) AS n FROM combos GROUP BY c
), combo AS (SELECT c, (ln(1 + (SELECT max(n) FROM counted)) - ln(1 + n)) / (ln(1 + (SELECT max(n) FROM counted)) - ln(1 + (SELECT min(n) FROM counted))) AS combo FROM counted
), tailed AS (SELECT ord, single, combo, 0.5::DOUBLE * single + 0.5::DOUBLE * combo AS tail FROM single JOIN combos USING (ord) JOIN combo USING (c)
), scored_tail AS (SELECT ord, single, combo, tail, (tail - min(tail) OVER ()) / (max(tail) OVER () - min(tail) OVER ()) AS score FROM tailed)"""

# Cleaning over documents and labels -----------------------------------------------------------------------------------


def _cleaning(s, d):
    rows = table(s, d, "documents").select("doc_id", F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit("\t")).alias("key"))
    clean = table(s, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("  ")).alias("key"))
    return rows, clean


def _nan_ids(s, d):
    rows = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 97 != 0, F.col("doc_id")).alias("id"))
    clean = table(s, d, "labels").select(F.when(F.col("doc_id") % 97 != 0, F.col("doc_id")).alias("id"))
    return split.matching_ids(rows, clean, "id").select("doc_id")


# Augmentation over documents ------------------------------------------------------------------------------------------


def sources(s, d):
    level = F.element_at(F.array(*map(F.lit, dims.POLICIES)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", level.alias("aug_level"))


def outcomes(s, d):
    ok = F.when(F.col("doc_id") % 13 == 0, F.lit(False)).when(F.col("doc_id") % 11 == 0, F.col("attempt") == 0).otherwise((F.col("doc_id") * 31 + F.col("attempt") * 17) % 10 < 6)
    done = tail.quota_outcomes(tail.attempts(sources(s, d), "doc_id", "aug_level"), "doc_id", ok)
    return done.withColumn("candidate", tail.candidate_id(F.col("doc_id").cast("string"), F.col("attempt") + 1)).withColumn("seed", tail.candidate_seed(42, F.col("doc_id"), F.col("attempt")))


def copies(s, d):
    return tail.oversampled(outcomes(s, d).where("event = 'accepted'"), "doc_id", "candidate")


_augment_sql = """src AS (
  SELECT doc_id, ['weak', 'medium', 'strong', 'extreme'][doc_id % 4 + 1] AS aug_level, [0, 1, 2, 4][doc_id % 4 + 1] AS target, [0, 1, 3, 5][doc_id % 4 + 1] AS b, [1, 1, 2, 2][doc_id % 4 + 1] AS copies FROM documents
), tries AS (
  SELECT *, i // b AS batch, CASE WHEN doc_id % 13 = 0 THEN false WHEN doc_id % 11 = 0 THEN i = 0 ELSE (doc_id * 31 + i * 17) % 10 < 6 END AS ok
  FROM (SELECT *, unnest(range(greatest(target, b) * 8)) AS i FROM src WHERE target > 0)
), summed AS (SELECT *, sum(ok::INT) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM tries
), cuts AS (SELECT doc_id, coalesce(min(batch) FILTER (ok AND c = target), max(batch)) AS last FROM summed GROUP BY doc_id
), made AS (
  SELECT s.*, CASE WHEN ok AND c <= target THEN 'accepted' WHEN ok THEN 'unused_accepted' ELSE 'rejected' END AS event, printf('%d__aug%03d', doc_id, i + 1) AS candidate, 42 + doc_id * 100000 + i AS seed
  FROM summed s JOIN cuts USING (doc_id) WHERE batch <= last
), clones AS (
  SELECT doc_id, aug_level, printf('%s__os%02d_%03d', candidate, r, c) AS img_id, printf('oversample_copy_%02d', r) AS ops, candidate AS copy_of
  FROM (SELECT *, unnest(range(1, copies)) AS r FROM made WHERE event = 'accepted')
)"""

# Two-key look-ups -----------------------------------------------------------------------------------------------------


def _lookup(s, d):
    docs = table(s, d, "documents")
    meta = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("ord"), F.concat(F.lit("R"), (F.col("doc_id") % 40).cast("string"), F.lit("\r\n")).alias("description"), F.col("source").alias("diseases"), F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.lit("strong")).alias("aug_level"), (F.col("doc_id") % 7 / 10.0).cast("double").alias("TailScore"))
    rows = docs.select("doc_id", F.concat(F.lit("R"), (F.col("doc_id") % 60).cast("string")).alias("answer"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit("none")).alias("diagnosis"))
    return tail.with_tail_metadata(rows, meta, "answer", "diagnosis").select("doc_id", "aug_level", r9("tail_score").alias("tail_score"))


_lookup_sql = """WITH meta AS (
  SELECT doc_id AS ord, concat('R', doc_id % 40) AS d, source AS x, CASE WHEN doc_id % 10 = 0 THEN 'weak' ELSE 'strong' END AS level, doc_id % 7 / 10.0::DOUBLE AS score FROM documents WHERE doc_id % 5 = 0
), a AS (SELECT d, arg_min(level, ord) AS level, arg_min(score, ord) AS score FROM meta GROUP BY d
), b AS (SELECT x, arg_min(level, ord) AS level, arg_min(score, ord) AS score FROM meta GROUP BY x
) SELECT doc_id, CASE WHEN a.d IS NOT NULL THEN a.level WHEN b.x IS NOT NULL THEN b.level ELSE 'weak' END AS aug_level, round(CASE WHEN a.d IS NOT NULL THEN a.score WHEN b.x IS NOT NULL THEN b.score ELSE 0 END, 9) AS tail_score
FROM documents r LEFT JOIN a ON a.d = concat('R', r.doc_id % 60) LEFT JOIN b ON b.x = r.source AND r.doc_id % 2 = 0"""

# Preferences over report pairs ----------------------------------------------------------------------------------------


def marked(s, d):
    return prefer.select_pairs(prefer.candidates(pairs(s, d)))


_mean = lambda p: f"({p}description_finding_set_f1 + {p}description_location_f1 + {p}description_count_bucket_acc + {p}description_cdr_tol_hit) / 4"
_prefer_sql = SCORE_CTES + f""", cand AS (
  SELECT ord, img_id, format_correct, diagnosis_exact_set_acc, {_mean('')} AS description_score,
    0.25::DOUBLE * 1 + 0.15::DOUBLE * 1 + 0.6::DOUBLE AS score_chosen, 0.25::DOUBLE * {_mean('')} + 0.15::DOUBLE * format_correct + 0.6::DOUBLE * diagnosis_exact_set_acc AS score_rejected FROM scored
), margins AS (SELECT *, score_chosen - score_rejected AS margin FROM cand
), chosen AS (
  SELECT *, round(margin, 9) >= (SELECT round(median(margin), 9) FROM margins) AS margin_kept FROM margins
), marked AS (SELECT *, margin_kept AND (diagnosis_exact_set_acc < 1 OR format_correct < 1 OR description_score < 0.8::DOUBLE) AS selected FROM chosen)"""
_sum = lambda n, c: f"count(*) FILTER ({c}) AS {n}_count_all, count(*) FILTER ({c} AND selected) AS {n}_count_selected"

# Checkpoints, series and logs over events -----------------------------------------------------------------------------


def _checkpoints(s, d):
    e = table(s, d, "events")
    return e.groupBy((F.col("user_id") % 40).alias("u")).agg(F.round(F.avg("value"), 6).alias("f1"), F.round(F.max("value"), 6).alias("acc"), F.count("*").alias("n")).select(
        F.concat(F.lit("checkpoint-"), (F.col("u") * 100).cast("string")).alias("name"), F.when(F.col("u") % 9 != 0, F.col("f1")).alias("f1"), F.col("acc"), F.col("n")
    ).withColumn("step", rank.checkpoint_step(F.col("name")))


_checkpoint_sql = """ck AS (
  SELECT concat('checkpoint-', u * 100) AS name, CASE WHEN u % 9 <> 0 THEN f1 END AS f1, acc, n, u * 100 AS step FROM (
    SELECT user_id % 40 AS u, round(avg(value), 6) AS f1, round(max(value), 6) AS acc, count(*) AS n FROM events GROUP BY u)
)"""


def _history(s, d):
    e = table(s, d, "events")
    return e.select("event_id", (F.col("event_id") % 500).alias("step"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("eval_loss"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("loss"))


_history_sql = "hist AS (SELECT event_id AS ord, event_id % 500 AS step, CASE WHEN event_id % 3 = 0 THEN 'eval' ELSE 'train' END AS kind, value FROM events WHERE value IS NOT NULL)"


def _log(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("input"), F.when(F.col("event_type") == "error", F.lit("error")).when(F.col("event_type") == "purchase", F.lit("skipped")).otherwise(F.lit("ok")).alias("status"), F.element_at(F.array(F.lit("crop"), F.lit("mask"), F.lit("plain")), (F.col("event_id") % 3 + 1).cast("int")).alias("mode"))


def _tasks(s, d):
    e = table(s, d, "events")
    tasks = e.select(F.col("event_id").alias("input"), F.concat(F.lit("out/"), F.col("event_id").cast("string")).alias("output"))
    outputs = e.where("event_id % 4 = 0").select(F.concat(F.lit("out/"), F.col("event_id").cast("string")).alias("output"))
    return tasks, outputs, _log(s, d).where("input % 3 = 0").select("input")


def _existing(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("key"), F.round("value", 6).alias("value"))
    return resume.existing_records([e.where("ord % 3 = 0"), e.where("ord % 3 = 1"), e.where("ord % 3 = 2")], "key", "ord")


# Kernels over embeddings ----------------------------------------------------------------------------------------------


def _logits(s, d):
    e = table(s, d, "embeddings").where("embedding IS NOT NULL")
    target = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 5 == 0, x <= 0).otherwise(x > 0).cast("double"))
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"), target.alias("y"))


_logit_sql = """cells AS (
  SELECT vec_id, label, i - 1 AS pos, embedding[i]::DOUBLE AS x, CASE WHEN (vec_id + i - 1) % 5 = 0 THEN embedding[i] <= 0 ELSE embedding[i] > 0 END AS t
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE embedding IS NOT NULL)
), loss AS (SELECT *, greatest(x, 0) - x * t::INT + ln(1 + exp(-abs(x))) AS bce, CASE WHEN t THEN 1 / (1 + exp(-x)) ELSE 1 - 1 / (1 + exp(-x)) END AS truth FROM cells)"""
_pool_sql = lambda how: f"""WITH c AS (SELECT label, vec_id, i - 1 AS pos, embedding[i]::DOUBLE AS v, vec_id % 2 AS m FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE embedding IS NOT NULL))
SELECT label, CAST(pos AS INTEGER) AS pos, round(coalesce({how}, 0), 9) AS value FROM c GROUP BY label, pos"""  # noqa: E731


def _pool(how):
    return lambda s, d: numeric.pooled(table(s, d, "embeddings").where("embedding IS NOT NULL").withColumn("m", F.col("vec_id") % 2), "label", "vec_id", "embedding", "m", how).withColumn("value", r9("value"))


def _focal(s, d):
    loss = numeric.focal_loss(F.col("x"), F.col("y"), F.transform("x", lambda x, i: (1 + i % 4) / F.lit(2.0)), 2.0)
    return _logits(s, d).select(loss.alias("l"), F.size("x").alias("n")).agg(r9(F.sum("l") / F.sum("n")).alias("loss"))


def _entropy(s, d):
    e = table(s, d, "embeddings").where("embedding IS NOT NULL").withColumn("next", F.when(F.col("vec_id") % 4 == 0, F.lit(-100)).otherwise(F.col("vec_id") % 64))
    return numeric.token_cross_entropy(e.withColumn("sequence", F.expr("vec_id DIV 32")), "sequence", "vec_id", "embedding", "next").select(r9("loss").alias("loss"))


def _sizes(s, d):
    w, h = numeric.longest_side(F.col("p_partkey") % 3000 + 1, F.col("p_partkey") * 7 % 2000 + 1, 1024)
    return table(s, d, "part").select("p_partkey", w.alias("width"), h.alias("height"))


# Messages over conversations ------------------------------------------------------------------------------------------


def _messages(s, d):
    rows = table(s, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("messages"))


def _loaded(s, d):
    path = work_path(s, "loaded")
    rows = table(s, d, "documents").withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.lit(" \n")).otherwise(F.col("text")))
    counts = split.write_loaded(rows.select("doc_id", "body"), "body", F.col("doc_id") % 5 != 0, path)
    return s.read.parquet(path).agg(F.count("*").alias("written")).select("written", *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


def _preferred(s, d):
    path = work_path(s, "preferences")
    figures = prefer.write_preferences(marked(s, d), path, "ord", "img_id")
    back = s.read.parquet(path).agg(F.count("*").alias("written"), r9(F.avg("margin")).alias("avg_margin_written"))
    return back.select("*", *[F.lit(v).alias(k) for k, v in figures.items()]).withColumns({c: r9(c) for c in ("margin_threshold", "avg_margin_all", "avg_margin_selected")})


QUERIES = {
    "written_load_counters": _loaded,
    "written_preferences": _preferred,
    "stratified_quota": lambda s, d: split.stratum_quotas(records(s, d), "diagnosis", 0.1, 0.05),
    "stratified_split": lambda s, d: divided(s, d).select("ord", "diagnosis", "split"),
    "split_sizes": lambda s, d: split.split_sizes(divided(s, d), "diagnosis"),
    "top_strata": lambda s, d: split.most_common(records(s, d), "diagnosis", "ord"),
    "label_vocab": vocabulary,
    "label_support": lambda s, d: split.label_support(divided(s, d).where("split = 'train'"), labels(), vocabulary(s, d)),
    "class_balanced_weights": lambda s, d: split.class_balanced_weights(split.label_support(divided(s, d).where("split = 'train'"), labels(), vocabulary(s, d))).withColumn("weight", r9("weight")),
    "kept_rows": lambda s, d: split.kept_and_removed(*_cleaning(s, d), "key")[0].select("doc_id"),
    "removed_rows": lambda s, d: split.kept_and_removed(*_cleaning(s, d), "key")[1].select("doc_id"),
    "filter_summary": lambda s, d: split.filter_summary(*_cleaning(s, d), "key"),
    "matching_ids": _nan_ids,
    "load_counters": lambda s, d: split.load_counters(table(s, d, "documents").withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.lit(" \n")).otherwise(F.col("text"))), "body", F.col("doc_id") % 5 != 0, "doc_id"),
    "tail_score": lambda s, d: scores(s, d).select("ord", *[r9(c).alias(c) for c in ("single", "combo", "tail", "score")]),
    "tail_bins": lambda s, d: tail.tail_bins(scores(s, d)).withColumn("share", r9("share")),
    "tail_levels": lambda s, d: scores(s, d).groupBy(tail.tail_level(F.col("score")).alias("level")).agg(F.count("*").alias("n")),
    "fallback_lookup": _lookup,
    "quota_accept": lambda s, d: outcomes(s, d).where("event = 'accepted'").select("doc_id", "aug_level", "candidate", "seed", F.col("nth").cast("long").alias("nth")),
    "quota_rejects": lambda s, d: outcomes(s, d).where("event <> 'accepted'").select("doc_id", "aug_level", "candidate", "event"),
    "oversample": copies,
    "augment_counters": lambda s, d: tail.counters(outcomes(s, d), sources(s, d), "aug_level"),
    "preference_pairs": lambda s, d: prefer.preference_records(marked(s, d), "ord", "img_id").drop("chosen", "rejected").withColumns({c: r9(c) for c in ("score_chosen", "score_rejected", "margin", "description_score")}),
    "preference_summary": lambda s, d: prefer.summary(marked(s, d)).withColumns({c: r9(c) for c in ("margin_threshold", "avg_margin_all", "avg_margin_selected")}),
    "checkpoint_rank": lambda s, d: rank.ranked(_checkpoints(s, d), ["f1", "acc"]).withColumn("rank", F.col("rank").cast("long")),
    "best_checkpoint": lambda s, d: rank.best(_checkpoints(s, d), "f1"),
    "training_hint": lambda s, d: rank.training_hint(_checkpoints(s, d), "f1"),
    "loss_series": lambda s, d: rank.loss_series(_history(s, d), "event_id").withColumn("value", r9("value")),
    "best_eval": lambda s, d: rank.best_eval(rank.loss_series(_history(s, d), "event_id")).withColumn("value", r9("value")),
    "loss_polyline": lambda s, d: rank.polyline(rank.loss_series(_history(s, d), "event_id")).select("ord", "kind", r9("x").alias("x"), r9("y").alias("y")),
    "resume_pending": lambda s, d: resume.pending(*_tasks(s, d), "input", "output"),
    "skip_counts": lambda s, d: resume.skip_counts(*_tasks(s, d), "input", "output"),
    "existing_records": _existing,
    "source_index": lambda s, d: resume.with_ordinal(table(s, d, "documents").select("doc_id"), "doc_id"),
    "status_rollup": lambda s, d: resume.status_rollup(_log(s, d)),
    "bce_metrics": lambda s, d: numeric.logit_metrics(_logits(s, d), "vec_id", "x", "y").select(*[r9(c).alias(c) for c in ("diag_bce_loss", "diag_exact_set_acc", "diag_micro_f1", "diag_macro_f1")]),
    "focal_loss": _focal,
    "masked_pool": _pool("mean"),
    "first_pool": _pool("first"),
    "last_pool": _pool("last"),
    "token_cross_entropy": _entropy,
    "longest_side": _sizes,
    "chat_messages": _messages,
}
ORACLE_SQL = {
    "stratified_quota": f"WITH {_split_sql} SELECT diagnosis, n, n - val - test AS train, val, test FROM q1",
    "stratified_split": f"WITH {_split_sql} SELECT ord, diagnosis, split FROM done",
    "split_sizes": f"WITH {_split_sql} SELECT split, count(*) AS rows, count(DISTINCT diagnosis) AS strata FROM done GROUP BY split",
    "top_strata": f"WITH rec AS ({RECORD_SQL}) SELECT diagnosis, count(*) AS n, min(ord) AS first FROM rec GROUP BY diagnosis ORDER BY n DESC, first LIMIT 20",
    "label_vocab": f"WITH {_label_sql} SELECT label, row_number() OVER (ORDER BY label) - 1 AS index FROM (SELECT DISTINCT label FROM lab)",
    "label_support": f"WITH {_support_sql} SELECT label, support FROM support",
    "class_balanced_weights": f"WITH {_support_sql}, w AS (SELECT *, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, greatest(support, 1))) AS w FROM support) SELECT label, support, round(CASE WHEN support = 0 THEN 1 ELSE w / (SELECT avg(w) FROM w) END, 9) AS weight FROM w",
    "kept_rows": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "removed_rows": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "filter_summary": "SELECT count(*) AS rows, (SELECT count(DISTINCT doc_id) FROM labels) AS clean_keys, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS kept, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS removed FROM documents",
    "matching_ids": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR (doc_id % 97 = 0 AND EXISTS (SELECT 1 FROM labels WHERE doc_id % 97 = 0))",
    "load_counters": "WITH r AS (SELECT doc_id % 7 = 0 OR coalesce(trim(text), '') = '' AS e, doc_id % 5 <> 0 AS f FROM documents) SELECT count(*) AS seen, count(*) FILTER (e) AS empty, count(*) FILTER (NOT e AND NOT f) AS unresolved, count(*) FILTER (NOT e AND f) AS kept FROM r",
    "written_load_counters": "SELECT *, kept AS written FROM (WITH r AS (SELECT doc_id % 7 = 0 OR coalesce(trim(text), '') = '' AS e, doc_id % 5 <> 0 AS f FROM documents) SELECT count(*) AS seen, count(*) FILTER (e) AS empty, count(*) FILTER (NOT e AND NOT f) AS unresolved, count(*) FILTER (NOT e AND f) AS kept FROM r)",
    "tail_score": f"WITH {_tail_sql} SELECT ord, round(single, 9) AS single, round(combo, 9) AS combo, round(tail, 9) AS tail, round(score, 9) AS score FROM scored_tail",
    "tail_bins": f"WITH {_tail_sql} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM scored_tail), 9) AS share FROM scored_tail GROUP BY bin",
    "tail_levels": f"WITH {_tail_sql} SELECT CASE WHEN score < 0.1::DOUBLE THEN 'weak' WHEN score < 0.35::DOUBLE THEN 'medium' WHEN score < 0.52::DOUBLE THEN 'strong' ELSE 'extreme' END AS level, count(*) AS n FROM scored_tail GROUP BY level",
    "fallback_lookup": _lookup_sql,
    "quota_accept": f"WITH {_augment_sql} SELECT doc_id, aug_level, candidate, seed, CAST(c AS BIGINT) AS nth FROM made WHERE event = 'accepted'",
    "quota_rejects": f"WITH {_augment_sql} SELECT doc_id, aug_level, candidate, event FROM made WHERE event <> 'accepted'",
    "oversample": f"WITH {_augment_sql} SELECT doc_id, img_id, ops, copy_of FROM clones",
    "augment_counters": f"""WITH {_augment_sql} SELECT counter, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT concat(event, '_', aug_level) AS counter, count(*) AS n FROM made GROUP BY 1 UNION ALL SELECT concat('candidate_', aug_level), count(*) FROM made GROUP BY 1
  UNION ALL SELECT concat('oversampled_', aug_level), count(*) FROM clones GROUP BY 1
  UNION ALL SELECT concat('shortfall_', aug_level), sum(target - coalesce(g, 0)) FROM src LEFT JOIN (SELECT doc_id, count(*) AS g FROM made WHERE event = 'accepted' GROUP BY doc_id) USING (doc_id) WHERE target > 0 GROUP BY 1 HAVING sum(target - coalesce(g, 0)) > 0
) GROUP BY counter""",
    "preference_pairs": f"WITH {_prefer_sql} SELECT ord, img_id, round(score_chosen, 9) AS score_chosen, round(score_rejected, 9) AS score_rejected, round(margin, 9) AS margin, format_correct, diagnosis_exact_set_acc, round(description_score, 9) AS description_score FROM marked WHERE selected",
    "preference_summary": f"WITH {_prefer_sql} SELECT count(*) AS num_candidates, count(*) FILTER (margin_kept) AS num_margin_kept, count(*) FILTER (selected) AS num_selected, round(median(margin), 9) AS margin_threshold, round(avg(margin), 9) AS avg_margin_all, round(coalesce(avg(margin) FILTER (selected), 0), 9) AS avg_margin_selected, {_sum('format_error', 'format_correct < 1')}, {_sum('diagnosis_error', 'diagnosis_exact_set_acc < 1')}, {_sum('low_description_score', 'description_score < 0.8::DOUBLE')} FROM marked",
    "written_preferences": f"SELECT *, num_selected AS written, avg_margin_selected AS avg_margin_written FROM (WITH {_prefer_sql} SELECT count(*) AS num_candidates, count(*) FILTER (margin_kept) AS num_margin_kept, count(*) FILTER (selected) AS num_selected, round(median(margin), 9) AS margin_threshold, round(avg(margin), 9) AS avg_margin_all, round(coalesce(avg(margin) FILTER (selected), 0), 9) AS avg_margin_selected, {_sum('format_error', 'format_correct < 1')}, {_sum('diagnosis_error', 'diagnosis_exact_set_acc < 1')}, {_sum('low_description_score', 'description_score < 0.8::DOUBLE')} FROM marked)",
    "checkpoint_rank": f"WITH {_checkpoint_sql} SELECT *, row_number() OVER (ORDER BY f1 DESC NULLS LAST, acc DESC NULLS LAST, step) AS rank FROM ck",
    "best_checkpoint": f"WITH {_checkpoint_sql} SELECT * FROM ck ORDER BY f1 DESC NULLS LAST, step LIMIT 1",
    "training_hint": f"WITH {_checkpoint_sql}, b AS (SELECT * FROM ck ORDER BY f1 DESC NULLS LAST, step LIMIT 1), l AS (SELECT * FROM ck ORDER BY step DESC LIMIT 1) SELECT b.step AS best_step, l.step AS latest_step, CASE WHEN b.step < l.step AND l.f1 <= b.f1 THEN 'best_earlier' WHEN b.step = l.step THEN 'best_latest' ELSE 'mixed' END AS hint FROM b, l",
    "loss_series": f"WITH {_history_sql} SELECT ord, step, kind, round(value, 9) AS value FROM hist",
    "best_eval": f"WITH {_history_sql} SELECT ord, step, round(value, 9) AS value FROM hist WHERE kind = 'eval' ORDER BY value, ord LIMIT 1",
    "loss_polyline": f"WITH {_history_sql} SELECT ord, kind, round(800.0::DOUBLE * (step - min(step) OVER ()) / (max(step) OVER () - min(step) OVER ()), 9) AS x, round(400.0::DOUBLE - 400 * (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 9) AS y FROM hist",
    "resume_pending": "SELECT event_id AS input, concat('out/', event_id) AS output FROM events WHERE event_id % 4 <> 0 AND event_id % 3 <> 0",
    "skip_counts": "SELECT count(*) AS tasks, count(*) FILTER (event_id % 4 = 0) AS skipped_output, count(*) FILTER (event_id % 4 <> 0 AND event_id % 3 = 0) AS skipped_log, count(*) FILTER (event_id % 4 <> 0 AND event_id % 3 <> 0) AS pending FROM events",
    "existing_records": "SELECT ord, key, value FROM (SELECT event_id AS ord, user_id AS key, round(value, 6) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "source_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS source_index FROM documents",
    "status_rollup": "WITH l AS (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'skipped' ELSE 'ok' END AS status, ['crop', 'mask', 'plain'][event_id % 3 + 1] AS mode FROM events) SELECT status, CASE WHEN status = 'ok' THEN mode ELSE '' END AS mode, count(*) AS n FROM l GROUP BY ALL",
    "bce_metrics": f"WITH {_logit_sql}, l AS (SELECT pos, count(*) FILTER (x > 0 AND t) AS tp, count(*) FILTER (x > 0 AND NOT t) AS fp, count(*) FILTER (NOT x > 0 AND t) AS fn FROM loss GROUP BY pos) SELECT (SELECT round(avg(bce), 9) FROM loss) AS diag_bce_loss, (SELECT round(avg(e::INT), 9) FROM (SELECT bool_and((x > 0) = t) AS e FROM loss GROUP BY vec_id)) AS diag_exact_set_acc, round(2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn), 9) AS diag_micro_f1, round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) FILTER (tp + fn > 0), 9) AS diag_macro_f1 FROM l",
    "focal_loss": f"WITH {_logit_sql} SELECT round(avg(bce * pow(1 - truth, 2) * (1 + pos % 4) / 2.0::DOUBLE), 9) AS loss FROM loss",
    "masked_pool": _pool_sql("sum(v * m) / greatest(sum(m), 1)"),
    "first_pool": _pool_sql("arg_min(v, vec_id) FILTER (m > 0)"),
    "last_pool": _pool_sql("arg_max(v, vec_id) FILTER (m > 0)"),
    "token_cross_entropy": "WITH e AS (SELECT *, lead(CASE WHEN vec_id % 4 = 0 THEN -100 ELSE vec_id % 64 END) OVER (PARTITION BY vec_id // 32 ORDER BY vec_id) AS nxt FROM embeddings WHERE embedding IS NOT NULL) SELECT round(avg(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) - embedding[nxt + 1]::DOUBLE), 9) AS loss FROM e WHERE nxt <> -100",
    "longest_side": "WITH p AS (SELECT p_partkey, p_partkey % 3000 + 1 AS w, p_partkey * 7 % 2000 + 1 AS h FROM part) SELECT p_partkey, CASE WHEN greatest(w, h) <= 1024 THEN w ELSE greatest(CAST(round_even(w * (1024::DOUBLE / greatest(w, h)), 0) AS BIGINT), 1) END AS width, CASE WHEN greatest(w, h) <= 1024 THEN h ELSE greatest(CAST(round_even(h * (1024::DOUBLE / greatest(w, h)), 0) AS BIGINT), 1) END AS height FROM p",
    "chat_messages": "SELECT conv_id, count(*) AS turns, string_agg(concat(role, ': ', coalesce(text, '')), chr(10) ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id",
}

