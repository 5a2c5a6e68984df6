"""Samples, shards and pairings that come out the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_key(key: Column, seed: int) -> Column:
    """Order of a seeded draw; md5, so that any engine can reproduce it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stable_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(stable_key(F.col(key), seed), key).limit(n)


def ranked(rows: DataFrame, key: str, name: str = "rn") -> DataFrame:
    """Dense positions from 0 by ``key`` without ordering all rows in one task."""
    from .reader import with_positions

    return with_positions(rows, [key]).withColumnRenamed("pos", name)


def stride_shard(rows: DataFrame, key: str, machines: int, ranks: int) -> DataFrame:
    """Every n-th key to a machine, every n-th of these to a rank."""
    return ranked(rows, key).withColumn("machine", (F.col("rn") % machines).cast("int")).withColumn("rank", (F.floor(F.col("rn") / machines) % ranks).cast("int")).drop("rn")


def chunk_assign(rows: DataFrame, key: str, workers: int) -> DataFrame:
    """Contiguous chunks of ceil(n / workers) keys."""
    total = rows.count()
    size = max(1, -(-total // workers))
    return ranked(rows, key).withColumn("worker", F.floor(F.col("rn") / size).cast("int")).drop("rn")


def even_split(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """Part i holds the keys at positions n*i//k up to n*(i+1)//k."""
    total = rows.count()
    # position p lies in the greatest i with n*i//k <= p, that is i = ceil((p+1)*k/n) - 1
    part = F.ceil((F.col("rn") + 1) * parts / F.lit(max(1, total))) - 1
    return ranked(rows, key).withColumn("part", part.cast("int")).drop("rn")


def seed_for(base: int, key: Column) -> Column:
    """Base plus the key's number, or the base where it is none."""
    return F.coalesce(F.lit(base).cast("long") + key.try_cast("bigint"), F.lit(base).cast("long"))


def balanced_pairs(contents: DataFrame, styles: DataFrame, prompts: DataFrame, rounds: int, seed: int = 0, used: DataFrame | None = None) -> DataFrame:
    """Content and style in rounds: each round shuffles both by a seeded hash and pairs place i of
    the styles with place i of the contents, contents repeating in a new order when used up. A
    content takes its next unused prompt each time it is drawn; without one the pair is dropped.
    ``contents``: content; ``styles``: style; ``prompts``: content, prompt; ``used``: content, prompt.
    Returns pair (content__style), content, style, prompt, round."""
    spark = contents.sparkSession
    n_content = contents.count()
    if n_content == 0 or styles.isEmpty():
        return spark.createDataFrame([], "pair string, content string, style string, prompt string, round int")
    n_style = styles.count()
    draws = styles.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    place = F.row_number().over(Window.partitionBy("round").orderBy(stable_key(F.concat_ws(":", "round", "style"), seed), "style"))
    draws = draws.withColumn("turn", F.col("round").cast("long") * n_style + place - 1)
    draws = draws.withColumn("cycle", F.floor(F.col("turn") / n_content)).withColumn("slot", F.col("turn") % n_content)
    cycles = F.explode(F.sequence(F.lit(0), F.lit(-(-rounds * n_style // n_content) - 1)))
    order = F.row_number().over(Window.partitionBy("cycle").orderBy(stable_key(F.concat_ws(":", "cycle", "content"), seed + 1), "content"))
    pool = contents.withColumn("cycle", cycles).withColumn("cycle", F.col("cycle").cast("long")).withColumn("slot", order - 1)
    left = prompts if used is None else prompts.join(used, ["content", "prompt"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("content").orderBy("prompt")) - 1
    lists = left.select("content", "prompt", nth.alias("cycle"))
    pairs = draws.join(pool, ["cycle", "slot"]).join(lists, ["content", "cycle"])
    named = pairs.select(F.concat_ws("__", "content", "style").alias("pair"), "content", "style", "prompt", "round", "turn")
    first = F.row_number().over(Window.partitionBy("pair").orderBy("turn"))
    return named.withColumn("__r", first).filter("__r = 1").drop("__r", "turn")
