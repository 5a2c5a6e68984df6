"""Key-joined score datasets: alignment, means, judge samples and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sigmoid

RESPONSE = "struct<choices:array<struct<message:struct<content:string>,text:string,logprobs:struct<content:array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>>>>>"


def common_keys(*sides: DataFrame, key: str = "key") -> DataFrame:
    """Inner join of keyed datasets."""
    joined = sides[0]
    for side in sides[1:]:
        joined = joined.join(side, key)
    return joined


def align(scores: DataFrame, metrics: list[str], strict: bool = False, missing: str = "N/A") -> DataFrame:
    """``scores``: key, metric, value. One row per key, one text column per metric; a missing value
    shows as ``missing``. Strict keeps only keys that have all metrics."""
    wide = scores.groupBy("key").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    if strict:
        return wide.filter(" and ".join(f"`{m}` is not null" for m in metrics))
    return wide.select("key", *[F.coalesce(F.format_string("%.4f", F.col(m)), F.lit(missing)).alias(m) for m in metrics])


def caption_lists(captions: DataFrame) -> DataFrame:
    """``captions``: key, file_no, value. The values of each key in the order of their files."""
    return captions.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "value"))), lambda e: e["value"]).alias("captions"))


def numbers_in(raw: Column) -> Column:
    """Numbers of one JSON score entry: a number or boolean, list items (number or {score}),
    {score}, or the values of an object one level deep. All else counts for nothing."""
    text = F.trim(raw)

    def number(value: Column) -> Column:
        plain = F.when(value == "true", 1.0).when(value == "false", 0.0).when(value.rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$"), value.try_cast("double"))
        return F.when(value.startswith("{"), F.get_json_object(value, "$.score").try_cast("double")).otherwise(plain)

    items = F.from_json(text, "array<string>")
    values = F.map_values(F.from_json(text, "map<string,string>"))
    score = F.get_json_object(text, "$.score").try_cast("double")
    one = lambda c: F.array(c)
    found = (
        F.when(text.startswith("["), F.transform(items, number))
        .when(text.startswith("{") & score.isNotNull(), one(score))
        .when(text.startswith("{"), F.transform(values, number))
        .otherwise(one(number(text)))
    )
    return F.filter(found, lambda x: x.isNotNull())


def metric_means(scores: DataFrame) -> DataFrame:
    """``scores``: dataset, raw. Mean of all numbers per dataset; NaN where there is none."""
    flat = scores.select("dataset", F.explode_outer(numbers_in(F.col("raw"))).alias("v"))
    return flat.groupBy("dataset").agg(F.coalesce(F.avg("v"), F.lit(float("nan"))).alias("mean"), F.count("v").alias("n"))


def judge_means(samples: DataFrame, least: int = 3) -> DataFrame:
    """``samples``: key, value. Mean of a key's samples, null where fewer than ``least`` are there."""
    return samples.groupBy("key").agg(F.when(F.count("value") >= least, F.avg("value")).alias("mean"), F.count("value").alias("n"))


def top_logprobs(raw: Column) -> Column:
    """array<struct<token, logprob>> of the first answer token of a judge response; the layouts
    choices[].logprobs.content[].top_logprobs, choices[].logprobs.top_logprobs[] (objects of
    token to logprob) and a bare list are understood."""
    parsed = F.from_json(raw, RESPONSE)
    nested = parsed["choices"][0]["logprobs"]["content"][0]["top_logprobs"]
    flat = F.from_json(F.get_json_object(raw, "$.choices[0].logprobs.top_logprobs[0]"), "map<string,double>")
    pairs = F.transform(F.map_entries(flat), lambda e: F.struct(e["key"].alias("token"), e["value"].alias("logprob")))
    bare = F.from_json(F.get_json_object(raw, "$.top_logprobs"), "array<struct<token:string,logprob:double>>")
    return F.coalesce(nested, pairs, bare)


def digit_logprob(entries: Column, digit: str, pick: str = "max") -> Column:
    """Log-probability of "0" or "1" among stripped tokens: the greatest, or the last listed."""
    hits = F.transform(F.filter(entries, lambda e: F.trim(e["token"]) == digit), lambda e: e["logprob"])
    return F.array_max(hits) if pick == "max" else F.try_element_at(hits, F.lit(-1))


def predicted_digit(content: Column) -> Column:
    first = F.substring(F.ltrim(content), 1, 1)
    return F.when(first.isin("0", "1"), first.cast("int"))


def probability_of_one(entries: Column, pick: str = "max") -> Column:
    one, zero = digit_logprob(entries, "1", pick), digit_logprob(entries, "0", pick)
    both = sigmoid(one - zero)
    return F.coalesce(both, F.when(one.isNotNull(), F.exp(F.least(one, F.lit(0.0)))), F.when(zero.isNotNull(), 1 - F.exp(F.least(zero, F.lit(0.0)))))


def confidence(predicted: Column, p_one: Column) -> Column:
    return F.when(predicted == 1, p_one).when(predicted == 0, 1 - p_one)


def remaining(tasks: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Tasks whose key is not in the output; a key stored with a null result is done."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def running_stats(rows: DataFrame, group: str, order: list[str], value: str, window: int = 20) -> DataFrame:
    """Median, mean and maximum of the last ``window`` values and the mean of all so far."""
    last = Window.partitionBy(group).orderBy(*order).rowsBetween(-(window - 1), 0)
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Spark's median takes no window frame, so the frame's few values are collected and sorted
    held = F.array_sort(F.collect_list(value).over(last))
    middle = (F.element_at("__held", F.ceil(F.size("__held") / 2).cast("int")) + F.element_at("__held", (F.floor(F.size("__held") / 2) + 1).cast("int"))) / 2
    rows = rows.withColumn("__held", held)
    return rows.select(group, *order, F.when(F.size("__held") > 0, middle).alias("median"), F.avg(value).over(last).alias("avg"), F.max(value).over(last).alias("max"), F.avg(value).over(upto).alias("global_avg"))
