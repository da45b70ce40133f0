"""Rewards of completions against gold fields, and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.structure import PLAIN_BUCKETS, measured_against
from ..functions.text import let, strip
from .parse import parsed
from .score import MEASURES, score_reports, weighted_scores

REWARDS = {"format": "format_score", "description": "description_score", "diagnosis": "diagnosis_score"}


def reward_modes(text: str) -> list[str]:
    """Names of rewards in a comma-separated text; ``all`` stands for every one."""
    names = [x.strip() for x in text.split(",") if x.strip()]
    if "all" in names:
        return list(REWARDS)
    unknown = [x for x in names if x not in REWARDS]
    if unknown or not names:
        raise ValueError(f"no such rewards: {unknown}" if unknown else "no reward is named")
    return names


def reward_weights(text: str, weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weight of each reward named; a single one weighs 1."""
    names, weights = reward_modes(text), weights or dims.FINAL_WEIGHTS
    return {names[0]: 1.0} if len(names) == 1 else {n: float(weights[n]) for n in names}


def gold_fields(df: DataFrame, truth: str) -> DataFrame:
    """``df`` with what scoring needs of the true report, taken once: normal form, sections, sorted sets, buckets as JSON with sorted keys, ratio."""
    rows = parsed(df, truth, "__g_")
    g = lambda name: F.col(f"__g_{name}")
    pairs = F.transform(g("buckets"), lambda x: F.concat(F.lit('"'), x["key"], F.lit('": "'), x["bucket"], F.lit('"')))
    return rows.select(
        *df.columns, g("norm").alias("ground_truth_normalized"), g("description").alias("gold_description"), g("diagnosis").alias("gold_diagnosis_text"), g("labels").alias("gold_diagnosis_labels"),
        g("findings").alias("gold_findings"), g("places").alias("gold_locations"), F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("gold_bucket_map_json"), g("ratio").alias("gold_cdr_value"),
    )


def decoded_buckets(c: Column) -> Column:
    """Map of a JSON text; blank text is an empty map."""
    return F.coalesce(F.from_json(F.nullif(F.trim(c), F.lit("")), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def rewards(df: DataFrame, key: str, completion: str, truth: str, modes: str = "all") -> DataFrame:
    """(key, <name>_reward for each mode). Each row is scored where it lies, so nothing is exchanged."""
    rows = df.select(key, F.col(completion).alias("prediction"), F.col(truth).alias("reference"))
    return weighted_scores(score_reports(rows)).select(key, *[F.col(REWARDS[m]).alias(f"{m}_reward") for m in reward_modes(modes)])


def contributions(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(reward, weighted_contribution, var): mean times weight, and the variance, of each reward."""
    sums = rows.agg(*[f.alias(f"{m}_{n}") for m in weights for n, f in (("mean", F.avg(f"{m}_reward")), ("std", F.stddev(f"{m}_reward")))])
    each = F.array(*[F.struct(F.lit(m).alias("reward"), (F.col(f"{m}_mean") * F.lit(w)).alias("weighted_contribution"), (F.col(f"{m}_std") * F.col(f"{m}_std")).alias("var")) for m, w in weights.items()])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def messages(prompt: Column, answer: Column | None = None) -> Column:
    """Chat messages: a user's text and, if there is an answer, the assistant's."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    user = F.array(one("user", prompt))
    return user if answer is None else F.when(answer.isNull(), user).otherwise(F.concat(user, F.array(one("assistant", answer))))


def _kind(v: Column) -> Column:
    """Type of a variant: STRING, OBJECT, ARRAY, VOID, BOOLEAN or a number's."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _said(v: Column) -> Column:
    """A plain value as Python prints it, stripped; lists and objects as JSON."""
    kind, text = _kind(v), F.try_variant_get(v, "$", "string")
    return strip(F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(text)).when(kind.isin("OBJECT", "ARRAY"), F.to_json(v)).otherwise(text))


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def content_text(content: Column) -> Column:
    """Text of a message's content, a variant: a text itself, an object's ``text``, or, of a list, its texts and its objects of type ``text`` line
    by line. Parts are stripped and blank ones go; an object without a text and other items of a list give nothing, other values are printed."""
    text = lambda x: F.coalesce(_said(F.try_variant_get(x, "$.text", "variant")), F.lit(""))
    one = lambda x: let(_kind(x), lambda k: F.when(k == "STRING", _said(x)).when((k == "OBJECT") & (F.try_variant_get(x, "$.type", "string") == "text"), text(x)).otherwise(F.lit("")))
    return let(_kind(content), lambda k: F.when(k == "OBJECT", text(content)).when(k == "ARRAY", _joined(F.transform(_items(content), one))).otherwise(_said(content)))


def message_text(completion: Column, depth: int = 8) -> Column:
    """Text of a completion, a variant: a text itself, an object's ``content``, or the texts of a list's items line by line, whatever lists
    these lie in, up to ``depth`` lists in one another; more are an error. Null for a null column."""
    leaves = F.array(completion)
    for _ in range(depth):
        leaves = F.flatten(F.transform(leaves, lambda x: F.when(_kind(x) == "ARRAY", _items(x)).otherwise(F.array(x))))
    content = lambda x: F.try_variant_get(x, "$.content", "variant")
    of_object = lambda x: F.when(content(x).isNull(), F.lit("")).otherwise(content_text(content(x)))
    one = lambda x: let(_kind(x), lambda k: F.when(k == "ARRAY", F.raise_error(F.lit(f"more than {depth} lists in one another")).cast("string")).when(k == "OBJECT", of_object(x)).otherwise(_said(x)))
    return F.when(completion.isNotNull(), _joined(F.transform(leaves, one)))


def evaluation_rows(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"prompt_text": "prompt", "ground_truth": "answer"})


def rerooted(path: Column, marker: str, root: str) -> Column:
    """A path moved into the marker folder below ``root``: what follows the folder's first occurrence, or the whole of a relative path;
    other absolute paths stay."""
    base, folder = F.lit(f"{root.rstrip('/')}/{marker}"), f"/{marker}/"
    rest = F.substring(path, F.instr(path, folder) + len(folder), F.length(path))
    return F.when(~F.startswith(path, F.lit("/")), F.concat_ws("/", base, path)).when(F.instr(path, folder) > 0, F.concat_ws("/", base, F.nullif(rest, F.lit("")))).otherwise(path)


def scored_against_gold(rows: DataFrame, completion: str) -> DataFrame:
    """``rows`` (with the columns of ``gold_fields``) with the eight measures of a completion; the truth isn't parsed again."""
    gold = lambda name: F.array_sort(F.array_distinct(F.coalesce(name, F.array().cast("array<string>"))))
    source = F.col("gold_bucket_map_json")
    entries = F.transform(F.map_entries(decoded_buckets(source)), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("bucket")))
    plain = F.coalesce(source.rlike(PLAIN_BUCKETS), F.lit(False))
    found = measured_against(MEASURES)(
        F.col(completion), gold("gold_diagnosis_labels"), F.coalesce("gold_description", F.lit("")), gold("gold_findings"), gold("gold_locations"), source, F.when(~plain, entries), F.col("gold_cdr_value").cast("double")
    )
    return rows.select("*", found.alias("__found")).select(*rows.columns, "__found.*")
