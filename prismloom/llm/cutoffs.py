"""Score cutoffs that keep a target share of each source: distributed quickselect.

All targets are searched at once. In each round every Arrow batch of scores gives,
per target, the median of what is left of its window; the weighted median of these
medians is the target's pivot; counting scores above and at the pivot discards one
side for good. At least a quarter of a window goes in each round, so rounds grow
with the logarithm of the rows; what is left is written anew whenever it has shrunk to a
quarter, so all rounds together read a fixed multiple of the scores. A target rank is
isolated in a window of at most ``finish_below`` scores, which is ranked. Nothing but one row per target and round reaches the driver.

Rules (TESTDATA.md, problem 4): n counts all images of the source, k = n * percent / 100
rounded up; the cutoff is the k-th best score, or the lowest score where fewer than k
images have one; ties with the cutoff are kept. Null and NaN are no scores. A target
with k = 0 or without any score has a null cutoff and keeps nothing; a source without
rows keeps nothing. Rows need not be unique; image ids are the store's key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import Workspace

class ShareCutoffs:
    """Finds the cutoffs of ``targets`` (source, score_name, keep_percent) over ``rows``."""

    def __init__(self, spark: SparkSession, rows: DataFrame, targets: DataFrame, key: str = "id", finish_below: int = 256):
        self.spark, self.rows, self.key, self.finish_below = spark, rows, key, finish_below
        wanted = targets.select("source", "score_name", "keep_percent").distinct().filter("source is not null and score_name is not null and keep_percent is not null").collect()  # one row per target: a parameter, not data
        unknown = {t.score_name for t in wanted} - set(rows.columns)
        if unknown:
            raise ValueError(f"no such score: {sorted(unknown)}")
        self.targets = sorted(((t.source, t.score_name, t.keep_percent) for t in wanted), key=str)
        self.space = Workspace(spark, "cutoffs")

    def _target_table(self) -> DataFrame:
        table = [(i, s, n) for i, (s, n, _) in enumerate(self.targets)]
        return F.broadcast(self.spark.createDataFrame(table, "gid int, source string, score_name string"))

    def _scores(self, *keep: str) -> DataFrame:
        """(gid, score, *keep): every score that some target looks at."""
        names = sorted({n for _, n, _ in self.targets})
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(f"`{n}`").cast("double").alias("score")) for n in names]))
        long = self.rows.select("source", *keep, pairs.alias("p")).select("source", *keep, "p.score_name", "p.score")
        return long.filter("score is not null and not isnan(score)").join(self._target_table(), ["source", "score_name"])

    def _state(self, state: dict[int, dict], *names: str) -> DataFrame:
        rows = [(g, *[float(s[n]) for n in names]) for g, s in state.items()]
        return F.broadcast(self.spark.createDataFrame(rows, ", ".join(["gid int", *[f"{n} double" for n in names]])))

    def find(self) -> list[dict]:
        """One dict per target: source, score_name, keep_percent, n, wanted, cutoff, kept."""
        if not self.targets:
            return []
        sizes = {r.source: r.n for r in self.rows.join(self._target_table().select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        scores = self.space.keep(self._scores().select("gid", "score"), "scores")
        have = {r.gid: r for r in scores.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).collect()}
        found, open_ = [], {}
        for g, (source, name, percent) in enumerate(self.targets):
            n = sizes.get(source, 0)
            wanted = max(0, -(-n * percent // 100))
            row = {"source": source, "score_name": name, "keep_percent": percent, "n": n, "wanted": wanted, "cutoff": None}
            found.append(row)
            if g in have and wanted:
                if wanted >= have[g].n:
                    row["cutoff"] = have[g].low
                else:
                    open_[g] = {"lo": float("-inf"), "hi": float("inf"), "k": wanted, "left": have[g].n}
        held = sum(s["left"] for s in open_.values())
        scores = scores.join(self._state(open_, "lo", "hi").select("gid"), "gid") if open_ else scores
        self.rounds = 0
        while any(s["left"] > self.finish_below for s in open_.values()):
            self.rounds += 1
            if 4 * sum(s["left"] for s in open_.values()) <= held:
                scores = self.space.keep(scores.join(self._state(open_, "lo", "hi"), "gid").filter("score > lo and score < hi").select("gid", "score"), "left")
                held = sum(s["left"] for s in open_.values())
            large = {g: s for g, s in open_.items() if s["left"] > self.finish_below}
            window = scores.join(self._state(large, "lo", "hi"), "gid").filter("score > lo and score < hi")
            for g, pivot, above, at in self._round(window):
                s = large[g]
                if above >= s["k"]:
                    s["lo"], s["left"] = pivot, above
                elif above + at >= s["k"]:
                    found[g]["cutoff"] = pivot
                    del open_[g]
                else:
                    s["left"] -= above + at
                    s["k"] -= above + at
                    s["hi"] = pivot
        if open_:
            rest = scores.join(self._state(open_, "lo", "hi", "k"), "gid").filter("score > lo and score < hi")
            rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.col("score").desc()))
            for r in rest.withColumn("r", rank).filter("r = k").select("gid", "score").collect():
                found[r.gid]["cutoff"] = r.score
        return found

    def _round(self, window: DataFrame) -> list[tuple]:
        def medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                groups = b.groupby("gid")["score"]
                yield pd.DataFrame([(g, float(np.partition(v.to_numpy(), (len(v) - 1) // 2)[(len(v) - 1) // 2]), len(v)) for g, v in groups], columns=["gid", "med", "w"])

        local = window.select("gid", "score").mapInPandas(medians, "gid int, med double, w long")
        # ties of a median are merged first, so that a window never holds more rows than distinct medians
        merged = local.groupBy("gid", "med").agg(F.sum("w").alias("w"))
        by = Window.partitionBy("gid")
        middle = merged.withColumn("upto", F.sum("w").over(by.orderBy("med"))).withColumn("all", F.sum("w").over(by)).filter("2 * upto >= all")
        pivots = {r.gid: r.pivot for r in middle.groupBy("gid").agg(F.min("med").alias("pivot")).collect()}
        table = F.broadcast(self.spark.createDataFrame(list(pivots.items()), "gid int, pivot double"))
        counted = window.join(table, "gid").groupBy("gid").agg(F.count_if(F.col("score") > F.col("pivot")).alias("above"), F.count_if(F.col("score") == F.col("pivot")).alias("at"))
        return [(r.gid, pivots[r.gid], r.above, r["at"]) for r in counted.collect()]

    def kept(self, found: list[dict] | None = None) -> DataFrame:
        """(source, score_name, key): the rows at or above their source's cutoff."""
        if not self.targets:
            return self.rows.select("source", F.lit("").alias("score_name"), self.key).limit(0)
        cuts = [(g, f["cutoff"]) for g, f in enumerate(self.find() if found is None else found) if f["cutoff"] is not None]
        table = F.broadcast(self.spark.createDataFrame(cuts, "gid int, cutoff double"))
        return self._scores(self.key).join(table, "gid").filter("score >= cutoff").select("source", "score_name", self.key)

    def report(self) -> DataFrame:
        """One row per target: sizes, cutoff and how many rows it keeps."""
        found = self.find()
        rows = [(f["source"], f["score_name"], f["keep_percent"], f["n"], f["wanted"], f["cutoff"]) for f in found]
        base = self.spark.createDataFrame(rows, "source string, score_name string, keep_percent int, n long, wanted long, cutoff double")
        kept = self.kept(found).groupBy("source", "score_name").agg(F.count(F.lit(1)).alias("kept"))
        return base.join(F.broadcast(kept), ["source", "score_name"], "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
