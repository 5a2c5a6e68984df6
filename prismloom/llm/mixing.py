"""Mixing sources to target shares of all tokens by Poisson replication.

Each document is repeated k times, k drawn from a Poisson distribution by inverting it at
a hash of (seed, document): the draw is the same on every run and every cluster. The
mean is the source's repetition rate, share * total / tokens of the source. No document
occurs more often than ``max_repeats``: the distribution is truncated there and its
parameter raised so that the mean still is the rate. A source whose rate would exceed
its cap contributes all it may; the rest of the total is spread over the other sources
in proportion to their shares, and the report gives target, expected and actual shares.

A target source without documents or tokens contributes nothing; sources that are no
target and documents with a null source are left out; repeated documents count each. The
default total is the number of tokens of all target sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Workspace
from .tokens import TOKENIZERS, VOCABULARY, count_tokens

def truncated_cdf(lam: float, cap: int) -> list[float]:
    """P(min(Poisson(lam), cap) <= k) for k = 0 .. cap - 1."""
    if lam <= 0:
        return [1.0] * cap
    total, out = 0.0, []
    for k in range(cap):
        # each term from its logarithm: exp(-lam) alone is no number for large lam
        total += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
        out.append(min(1.0, total))
    return out


def truncated_mean(lam: float, cap: int) -> float:
    return sum(1 - c for c in truncated_cdf(lam, cap))


def rate_parameter(rate: float, cap: int) -> float:
    """The parameter whose distribution, truncated at ``cap``, has mean ``rate``."""
    low, high = 0.0, 1.0
    while truncated_mean(high, cap) < rate:  # the mean rises to the cap, which lies above the rate
        high *= 2
    while high - low > 1e-9 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if truncated_mean(mid, cap) < rate else (low, mid)
    return high


def repetition_rates(targets: dict[str, tuple[float, int]], tokens: dict[str, int], total: float) -> dict[str, float]:
    """Repetitions per source by filling: capped sources give all, the others share what is left."""
    open_ = {s for s in targets if tokens.get(s, 0) > 0 and targets[s][0] > 0 and targets[s][1] > 0}
    rates, left = dict.fromkeys(targets, 0.0), total
    while open_:
        weight = sum(targets[s][0] for s in open_)
        capped = {s for s in open_ if left * targets[s][0] / weight >= targets[s][1] * tokens[s]}
        if not capped:
            return rates | {s: left * targets[s][0] / weight / tokens[s] for s in open_}
        for s in capped:
            rates[s] = float(targets[s][1])
            left -= targets[s][1] * tokens[s]
        open_ -= capped
    return rates


class SourceMix:
    def __init__(self, spark: SparkSession, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        self.spark, self.seed = spark, seed
        self.space = Workspace(spark, "mix")
        rows = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()  # one row per target: a parameter, not data
        self.targets = {r.source: (float(r.share or 0), int(r.cap or 0)) for r in rows}
        names = F.broadcast(spark.createDataFrame([(s,) for s in self.targets], "source string"))
        wanted = documents.select("doc_id", "source", "text").join(names, "source", "left_semi")
        self.sizes = self.space.keep(count_tokens(wanted, folder=folder, vocabulary=vocabulary, keep=("doc_id", "source")), "sizes")
        self.tokens = {r.source: int(r.t) for r in self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
        self.total = sum(self.tokens.values()) if total_tokens is None else total_tokens
        self.rates = repetition_rates(self.targets, self.tokens, self.total)

    def _uniform(self) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.col("doc_id")), 11)
        return bits.cast("double") / F.lit(float(2**53))

    def counted(self) -> DataFrame:
        """doc_id, source, n_tokens, repeats (also 0)."""
        steps = []
        for s, rate in self.rates.items():
            cap = self.targets[s][1]
            cdf = [1.0] if rate <= 0 else [] if rate >= cap else truncated_cdf(rate_parameter(rate, cap), cap)
            steps.append((s, cdf if rate < cap else [-1.0] * cap))
        table = F.broadcast(self.spark.createDataFrame(steps, "source string, cdf array<double>"))
        draws = self.sizes.join(table, "source").withColumn("u", self._uniform())
        return draws.select("doc_id", "source", "n_tokens", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("repeats"))

    def chosen(self) -> DataFrame:
        """doc_id, source, repeat_no, n_tokens, shuffle_key; globally shuffled by the key."""
        copies = self.counted().filter("repeats > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("repeat_no"))
        keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(self.seed + 1), "doc_id", "repeat_no"))
        return keyed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key").select("doc_id", "source", "repeat_no", "n_tokens", "shuffle_key")

    def report(self) -> DataFrame:
        """Per target source: shares asked, expected and reached, repeats and sizes."""
        got = {r.source: r for r in self.counted().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.sum("repeats").alias("d"), F.max("repeats").alias("m")).collect()}
        all_tokens = sum(int(r.t) for r in got.values()) or 1
        expected = {s: self.rates[s] * self.tokens.get(s, 0) for s in self.targets}
        whole = sum(expected.values()) or 1
        rows = [(s, share, cap, self.tokens.get(s, 0), self.rates[s], expected[s] / whole, int(got[s].t) if s in got else 0, int(got[s].t) / all_tokens if s in got else 0.0, int(got[s].d) if s in got else 0, int(got[s].m) if s in got else 0) for s, (share, cap) in sorted(self.targets.items())]
        return self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens long, rate double, expected_share double, chosen_tokens long, actual_share double, chosen_docs long, most_repeats int")
