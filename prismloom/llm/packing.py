"""Filling rows of fixed capacity with texts of varying length: exact-complement hashing.

Only the histogram of lengths is planned on the driver; its size is bounded by the
capacity, never by the data. A row is opened with the largest length left and grown by
the largest that fits; as soon as the gap equals one length, a sum of two or of three
lengths on hand (the index of sums), that exact complement closes the row. The pattern
so found is consumed as often as its lengths' counts allow. What cannot be closed
exactly is best-fit residue.

A text longer than the capacity is cut into full rows and one remainder, which is
packed like a text; no other text is split. A text without tokens (null or empty)
gets a null row and position. Repeated rows are texts of their own.

Scale: ranks within a length come from counts per hash partition and length, so a length
shared by a third of all texts is never ordered in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import Workspace
from .tokens import TOKENIZERS, VOCABULARY, count_tokens


class SumIndex:
    """Which gaps one, two or three available lengths fill exactly."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self._pairs: np.ndarray | None = None
        self._triples: np.ndarray | None = None
        self._alive = -1

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Which sums two and three lengths on hand reach, up to the capacity."""
        # sums only disappear as counts fall, so a stale index errs towards a failed look-up
        alive = int((self.counts > 0).sum())
        if self._pairs is None or alive < 0.8 * self._alive:
            have = np.flatnonzero(self.counts > 0)
            mask = self.counts > 0
            pairs, triples = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
            for a in have:
                pairs[a:] |= mask[: len(mask) - a]
            for a in have:
                triples[a:] |= pairs[: len(mask) - a]
            self._pairs, self._triples, self._alive = pairs, triples, alive
        return self._pairs, self._triples

    def pair(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        if gap < 2:
            return None
        half = np.arange((gap + 1) // 2, min(gap, len(self.counts)))
        fits = half[(self.counts[half] > 0) & (self.counts[gap - half] > 0)]
        for a in fits[::-1]:
            combo = (int(a), gap - int(a))
            if self.enough(combo, used):
                return combo
        return None

    def enough(self, combo: tuple[int, ...], used: Counter) -> bool:
        need = used + Counter(combo)
        return all(self.counts[v] >= n for v, n in need.items())

    def fill(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        if gap < len(self.counts) and self.counts[gap] > 0 and self.enough((gap,), used):
            return (gap,)
        pairs, triples = self._sums()
        if pairs[gap] and (found := self.pair(gap, used)):
            return found
        if not triples[gap]:
            return None
        first = np.arange(1, gap - 1)
        ok = (self.counts[first] > 0) & pairs[gap - first]
        for a in first[ok][::-1]:
            more = used + Counter([int(a)])
            if self.counts[a] >= more[int(a)] and (found := self.pair(gap - int(a), more)):
                return (int(a), *found)
        return None


def plan_rows(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a row, number of such rows) that use up the histogram."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    counts[0] = 0
    index, plan = SumIndex(counts), []
    while counts.any():
        gap, lengths, used = capacity, [], Counter()
        while True:
            largest = int(np.flatnonzero(counts > 0)[-1])
            combo = index.fill(gap, used) if gap <= 3 * largest else None  # three lengths reach no further
            if combo:
                lengths += combo
                break
            free = np.flatnonzero(counts[: gap + 1] > 0)
            nxt = next((int(a) for a in free[::-1] if counts[a] > used[int(a)]), None)
            if nxt is None:
                break
            # several copies of one length at once while far from the end of the row
            lengths.append(nxt)
            used[nxt] += 1
            gap -= nxt
        need = Counter(lengths)
        times = min(int(counts[v]) // n for v, n in need.items())
        for v, n in need.items():
            counts[v] -= n * times
        plan.append((tuple(lengths), times))
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each slot, first row and position within the row."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter = Counter()
    row = 0
    for lengths, times in plan:
        position = 0
        for v in lengths:
            found.setdefault(v, []).append((ranks[v], row, position))
            ranks[v] += times
            position += v
        row += times
    return {v: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for v, s in found.items()}


def pack(spark: SparkSession, sizes: DataFrame, capacity: int, key: str = "doc_id", rows_per_part: int = 20_000) -> DataFrame:
    """``sizes``: key, n_tokens. Returns key, piece_no, n_tokens, row_no, position."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    space = Workspace(spark, "packing")
    kind = dict(sizes.dtypes)[key]
    known = space.keep(sizes.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n")), "sizes")
    parts = max(1, known.count() // rows_per_part)
    lengths = F.transform(F.sequence(F.lit(1), F.ceil(F.col("n") / capacity).cast("int")), lambda i: F.least(F.lit(capacity).cast("long"), F.col("n") - (i - 1) * capacity))
    pieces = known.filter("n > 0").select("k", F.posexplode(lengths).alias("piece", "len"), F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int").alias("part"))
    items = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("part", "len").orderBy("k", "piece")))
    items = space.keep(items, "items")
    counts = items.groupBy("len", "part").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("len", "part", F.coalesce(before, F.lit(0)).alias("skip"))
    histogram = {int(r.len): int(r.c) for r in counts.groupBy("len").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    slots = _slots(plan_rows(histogram, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, position = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            length, rank = b["len"].to_numpy(), b["rank"].to_numpy()
            for v in np.unique(length):
                at = length == v
                first, base, pos = slots[int(v)]
                i = np.searchsorted(first, rank[at], "right") - 1
                row[at], position[at] = base[i] + rank[at] - first[i], pos[i]
            yield pd.DataFrame({"k": b["k"], "piece_no": b["piece"] + 1, "n_tokens": length.astype("int32"), "row_no": row, "position": position.astype("int32")})

    ranked = items.join(offsets, ["len", "part"]).select("k", "piece", "len", (F.col("skip") + F.col("nth") - 1).alias("rank"))
    placed = ranked.mapInPandas(place, f"k {kind}, piece_no int, n_tokens int, row_no long, position int")
    empty = known.filter("n = 0").select("k", F.lit(1).alias("piece_no"), F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("row_no"), F.lit(None).cast("int").alias("position"))
    return placed.unionByName(empty).withColumnRenamed("k", key)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """What the rows of ``pack`` hold, and whether they are sound: n_rows, n_tokens, n_pieces, fill (share of
    the rows' places in use) and faults (rows over capacity, with a gap or an overlap, plus missing numbers)."""
    rows = placed.filter("row_no is not null").groupBy("row_no").agg(F.sum("n_tokens").alias("t"), F.max(F.col("position") + F.col("n_tokens")).alias("end"), F.sum((2 * F.col("position").cast("long") + F.col("n_tokens")) * F.col("n_tokens")).alias("area"), F.count(F.lit(1)).alias("p"))
    # places 0 .. t-1 each once: the last one ends at t and the places' sum is that of 0 .. t-1
    bad = (F.col("end") != F.col("t")) | (F.col("area") != F.col("t") * F.col("t")) | (F.col("t") > capacity)
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pieces"), F.count_if(bad).alias("bad"), F.coalesce(F.max("row_no") + 1, F.lit(0)).alias("top"))
    return total.select("n_rows", "n_tokens", "n_pieces", F.round(F.col("n_tokens") / F.nullif(F.col("n_rows") * capacity, F.lit(0)), 6).alias("fill"), (F.col("bad") + F.col("top") - F.col("n_rows")).alias("faults"))


def sizes_of(spark: SparkSession, documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of each whole text, counted once and written."""
    return Workspace(spark, "tokens").keep(count_tokens(documents, folder=folder, vocabulary=vocabulary, keep=("doc_id",)), "sizes")


def pack_documents(spark: SparkSession, documents: DataFrame, capacity: int, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(spark, count_tokens(documents, folder=folder, vocabulary=vocabulary, keep=("doc_id",)), capacity)
