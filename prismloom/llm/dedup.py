"""Each new batch against all accepted history: persisted inverted-file vector cells.

A 256-bit hash is cut into 16 sub-vectors of 16 bits; a sub-vector's place and value name a
*cell* that holds the full vectors with that value there. A query probes in each place the
cells by rising distance: first its own, then the 16 at one bit. After these the distance
bound ends the search: a vector not met differs by two bits or more in all 16 places, hence by
32 or more. So every vector within 31 bits is met. What is met is reranked exactly: the two
neighbouring sub-vectors first (one of the 8 pairs differs by 3 bits or fewer), then all bits.

The index is a folder: cells packed into pages of sorted vectors, the file hashes, and a
manifest that names the committed generations; ``DedupIndex(spark, path)`` opens it again in any
session. A batch is decided and its accepted rows are appended as a generation; what is stored
is neither shuffled nor written again, but for merging generations of one size class (each
vector once per class) and for splitting cells into more buckets as the index grows fourfold. A
bucket with more than ``split`` vectors, as a hot cell gives, is compared block by block.

Rows are decided in slices by rising order, of up to ``SLICE`` rows, each of which is stored before the
next. A large batch makes several slices; of a history that is fed as a whole, small batches in a row
share one, so that a pass over the stored pages serves many rows. Where a sample shows a large group of
near-duplicates, slices begin small and grow by ``GROWTH``, so that the first accepts one of the group and all
later ones meet it as stored; no group is ever expanded into all its pairs. Within a slice a
row lists at most ``listed`` neighbours a place; a row that these cannot decide goes on to the
next slice, where it is compared again, so the limit loses nothing.

Order and rules (TESTDATA.md, problem 3): rows count by rising (batch_id, id); a row is a
duplicate when an accepted earlier row has its file_hash or a pdq_hash within 31 bits.

Results for odd input: a null hash never matches; a pdq_hash that is not 32 bytes long is
treated as null; a null batch_id counts before all others; repeated rows (same id) are one
row; an empty batch changes nothing; extra columns are ignored.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import id_key, key_text
from ..plans.buckets import BucketedTable, even_codes
from ..plans.storage import Workspace, free_shuffles, read_note, write_note

RADIUS = 31
PLACES = 16
#: Values at no bit and at one bit from a sub-vector: the cells a query probes in one place.
FLIPS = np.array([0, *(1 << i for i in range(16))], np.int64)
#: Queries and candidate pairs taken at a time, so that they stay in a core's cache; pairs held before lists are cut.
BLOCK, CHUNK, HELD = 4096, 250_000, 1_000_000
FIRST_SLICE, GROWTH = 20_000, 8
#: Rows of a slice at most. A pass over the stored pages takes as long as comparing some 80,000 rows with them.
SLICE = 160_000
#: Rows of a sample in one cell from which a group is large.
GROUP = 32
#: Buckets of a new index; each growth splits all of them into four.
CELL_BUCKETS, MARK_BUCKETS = PLACES // 2, 4
#: ``slots`` is empty: the vectors tell them. Folders written before hold them.
PAGES = "part int, place int, n int, lo int, hi int, slots binary, vectors binary"
HITS = "a binary, b binary, old boolean, upto binary"
ACCEPTED = "mark binary, key binary"


def whole_hash(col: Column) -> Column:
    """A hash of 32 bytes, null for anything else."""
    return F.when(F.octet_length(col) == 32, col)


def _observed(seen: Observation, name: str) -> int | None:
    """An observed number, None where the plan was found to be empty and gave none."""
    from py4j.protocol import Py4JJavaError

    try:
        return seen.get.get(name)
    except Py4JJavaError:
        return None


def _matrix(values) -> np.ndarray:
    """Rows of 32 bytes."""
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 32)


def _slot(vectors: np.ndarray, place: int) -> np.ndarray:
    return vectors[:, 2 * place].astype(np.int64) * 256 + vectors[:, 2 * place + 1]


class _Cells:
    """Vectors by their sub-vector at one place: their order, with the start of each cell."""

    def __init__(self, vectors: np.ndarray, place: int):
        slots = _slot(vectors, place)
        self.order = np.argsort(slots.astype(np.uint16), kind="stable").astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=65536))]).astype(np.int32)
        self.pairs = _neighbours(vectors, place)[self.order]
        self.words = vectors.view(np.uint64)


def _neighbours(vectors: np.ndarray, place: int) -> np.ndarray:
    """The sub-vector and its neighbour, as 32 bits."""
    return np.ascontiguousarray(vectors.reshape(-1, 8, 4)[:, place // 2]).view(np.uint32).ravel()


def _met(queries: np.ndarray, cells: _Cells, place: int):
    """Chunks of (query, vector) of all pairs within the radius that this place's probes meet."""
    slots, pairs, words = _slot(queries, place), _neighbours(queries, place), np.ascontiguousarray(queries).view(np.uint64)
    by_slot = np.argsort(slots.astype(np.uint16), kind="stable")
    for i in range(0, len(queries), BLOCK):
        block = by_slot[i : i + BLOCK]
        want = (slots[block][:, None] ^ FLIPS[None, :]).ravel()
        low = cells.starts[want]
        counts = cells.starts[want + 1] - low
        owner = np.repeat(block, len(FLIPS))
        owner, low, counts = (v[counts > 0] for v in (owner, low, counts))
        cut = np.cumsum(counts, dtype=np.int64)
        start = 0
        while start < len(counts):
            done = int(cut[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(cut, done + CHUNK, "right")))
            c, ends, own = counts[start:stop], cut[start:stop] - done, owner[start:stop]
            x = np.repeat((low[start:stop] - (ends - c)).astype(np.int32), c)
            x += np.arange(len(x), dtype=np.int32)
            near = np.flatnonzero(np.bitwise_count(cells.pairs[x] ^ np.repeat(pairs[own], c)) <= 3)
            q, x = own[np.searchsorted(ends, near, "right")], cells.order[x[near]]
            near = np.bitwise_count(words[q] ^ cells.words[x]).sum(axis=1, dtype=np.int64) <= RADIUS
            yield q[near], x[near]
            start = stop


def _first_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place at which a pair is met, so that it is listed once."""
    bits = np.bitwise_count(a ^ b).reshape(-1, 16, 2).sum(axis=2)
    both = np.repeat(bits.reshape(-1, 8, 2).sum(axis=2), 2, axis=1)
    return np.argmax((bits <= 1) & (both <= 3), axis=1)


def match_part(new: pd.DataFrame, pages: pd.DataFrame, listed: int = 64) -> pd.DataFrame:
    """``match_place`` for each place of one part."""
    out: list[tuple] = []
    for place, rows in new.groupby("place"):
        out += match_place(int(place), rows, pages[pages["place"] == place] if len(pages) else pages, listed)
    return pd.DataFrame(out, columns=["a", "b", "old", "upto"])


def match_place(place: int, new: pd.DataFrame, pages: pd.DataFrame, listed: int) -> list[tuple]:
    """The matches of a part at one place. ``new``: h, ord, is_query, is_stored; ``pages``: vectors.
    A query that meets a stored vector gives one row (old). Any other lists its neighbours of
    the same batch by their order, at most ``listed``; where there are others, ``upto`` is the order of
    the last one listed."""
    out: list[tuple] = []
    asked = new[new["is_query"].to_numpy(bool)]
    if len(asked):
        queries = _matrix(asked["h"])
        open_ = np.ones(len(queries), bool)
        if len(pages):
            stored = _Cells(_matrix(pages["vectors"]), place)
            for q, _ in _met(queries, stored, place):
                open_[q] = False
            del stored
            out += [(queries[i].tobytes(), None, True, None) for i in np.flatnonzero(~open_)]
        fresh = new[new["is_stored"].to_numpy(bool)]
        gone = set(asked["h"].to_numpy()[~open_])
        fresh = fresh[[h not in gone for h in fresh["h"]]] if gone else fresh
        left = queries[open_]
        if len(left) and len(fresh):
            vectors, fresh_at = _matrix(fresh["h"]), fresh["ord"].to_numpy()
            q, x, more = _listed(left, vectors, fresh_at, place, listed)
            a, b = left[q], vectors[x]
            # a pair is listed where it is met first; lists that are cut stay whole
            keep = (_first_place(a, b) == place) | more[q] if len(a) else np.zeros(0, bool)
            last = dict(zip(q.tolist(), x.tolist(), strict=True))
            out += [(u.tobytes(), v.tobytes(), False, fresh_at[last[i]] if more[i] else None) for u, v, i in zip(a[keep], b[keep], q[keep].tolist(), strict=True)]
    return out


def _listed(queries: np.ndarray, vectors: np.ndarray, at: np.ndarray, place: int, listed: int):
    """Pairs (query, vector) of unequal vectors, for each query the ``listed`` first ones by rising ``at``
    of the vector; and which queries have others."""
    more = np.zeros(len(queries), bool)
    q, x = np.zeros(0, np.int64), np.zeros(0, np.int32)
    new: list[tuple] = []

    def cut():
        every_q, every_x = (np.concatenate(v) for v in zip((q, x), *new, strict=True))
        met, back = np.unique(every_x, return_inverse=True)
        rank = np.empty(len(met), np.int64)
        rank[sorted(range(len(met)), key=lambda i: at[met[i]])] = np.arange(len(met))
        order = np.lexsort((rank[back], every_q))
        every_q, every_x = every_q[order], every_x[order]
        nth = np.arange(len(every_q)) - np.searchsorted(every_q, every_q, "left")
        more[every_q[nth >= listed]] = True
        return every_q[nth < listed], every_x[nth < listed]

    for some_q, some_x in _met(queries, _Cells(vectors, place), place):
        apart = (queries[some_q] != vectors[some_x]).any(axis=1)
        if apart.any():
            new.append((some_q[apart], some_x[apart]))
            if sum(len(v) for v, _ in new) > HELD:
                q, x = cut()
                new = []
    return *(cut() if new else (q, x)), more


def decide(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Rows (ord, f, h) of one slice in their order, by their ``links`` (HITS): accepted (1), duplicate
    (0) or left for the next slice (2), which befalls a row whose listed neighbours cannot tell."""
    near: dict[bytes, set] = {}
    upto: dict[bytes, bytes] = {}
    dead = set(links["a"][links["old"].to_numpy(bool)])
    links = links[~links["old"].to_numpy(bool)]
    for a, b, last in zip(links["a"], links["b"], links["upto"], strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        if last is not None:
            upto[a] = min(upto.get(a, last), last)
    files, wait_files, hit, wait = set(), set(), dead, set()
    out = []
    for o, f, h in sorted(zip(rows["ord"], rows["f"], rows["h"], strict=True), key=lambda r: r[0]):
        if f in files or h in hit:
            out.append((o, f, h, 0))
            continue
        reach = (h, *near.get(h, ())) if h is not None else ()
        if f in wait_files or h in wait or (h in upto and upto[h] < o):
            state, marked_f, marked_h = 2, wait_files, wait
        else:
            state, marked_f, marked_h = 1, files, hit
        if f is not None:
            marked_f.add(f)
        marked_h.update(reach)
        out.append((o, f, h, state))
    return pd.DataFrame(out, columns=["ord", "f", "h", "state"])


def pack_pages(place: int, part: int, vectors: np.ndarray, size: int) -> list[tuple]:
    slots = _slot(vectors, place)
    order = np.argsort(slots, kind="stable")
    slots, vectors = slots[order], vectors[order]
    return [(part, place, len(s), int(s[0]), int(s[-1]), b"", v.tobytes()) for i in range(0, len(slots), size) for s, v in [(slots[i : i + size], vectors[i : i + size])]]


class DedupIndex:
    """Accepted images in the folder ``path``: pages of vector cells, file hashes and a manifest."""

    def __init__(self, spark: SparkSession, path: str | None = None, per_part: int = 1_000_000, split: int = 2_000_000, page: int = 16_384, merge: int = 8, finish: int = 2 * FIRST_SLICE, listed: int = 64, expected: int = 0):
        """``per_part`` vectors are held by a bucket before cells are split into more of them; see the
        module for ``split``. ``page`` is the number of vectors of a page, ``merge`` the number of generations
        of a size class that become one, ``finish`` how many tied rows one task decides at a time. A new index is laid out for
        ``expected`` vectors, so that it need not be split while they come."""
        self.spark, self.per_part, self.split, self.page, self.merge, self.finish, self.listed = spark, per_part, split, page, merge, finish, listed
        self.space = Workspace(spark, "dedup", path)
        self._note = f"{self.space.path}/manifest.json"
        self.state = read_note(spark, self._note) or {"bits": 0, "layout": 0, "next": 1, "vectors": {}, "rows": {}}
        while self.state["next"] == 1 and expected > per_part << self.state["bits"] and self.state["bits"] < 12:
            self.state["bits"] += 2
        self._open_tables()

    def _open_tables(self) -> None:
        self.parts = CELL_BUCKETS << self.state["bits"]
        self.cells = BucketedTable(self.spark, f"{self.space.path}/cells-{self.state['layout']}", PAGES, "part", self.parts)
        self.accepted = BucketedTable(self.spark, f"{self.space.path}/accepted-{self.state['layout']}", ACCEPTED, "mark", MARK_BUCKETS << self.state["bits"])

    @property
    def size(self) -> int:
        """Vectors held."""
        return sum(self.state["vectors"].values())

    def _gens(self, kind: str) -> list[int]:
        return [int(g) for g in self.state[kind]]

    def close(self) -> None:
        """Leave the catalog; the folder can be opened again."""
        self.cells.close()
        self.accepted.close()

    def drop(self) -> None:
        self.close()
        self.space.drop()

    # -- cells -----------------------------------------------------------------------
    def _part(self, slot: Column) -> Column:
        """The bucket of a cell: its place and, as the index grows, the first bits of its value. A bucket
        of a new index holds two places, which ``place`` tells apart."""
        number = F.shiftright(F.shiftleft("place", 16) + slot, 17 - self.state["bits"])
        if self.parts > 4096:
            return number
        return F.element_at(F.array(*[F.lit(c) for c in even_codes(self.parts)]), number + 1)

    @staticmethod
    def _slot_of(place: Column) -> Column:
        return F.conv(F.hex(F.substring("h", 2 * place + 1, F.lit(2))), 16, 10).cast("int")

    def _stored(self, vectors: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """(part, place, h): each vector once a place, in the bucket of its cell."""
        rows = vectors.select("h", *keep, F.explode(F.array(*[F.lit(p) for p in range(PLACES)])).alias("place"))
        slot = self._slot_of(F.col("place")) if self.state["bits"] > 1 else F.lit(0)
        return rows.select(self._part(slot).alias("part"), "place", "h", *keep)

    def _asked(self, vectors: DataFrame) -> DataFrame:
        """As ``_stored``, and besides in the buckets of cells at one of the bits that tell buckets apart."""
        bits = self.state["bits"]
        if bits < 2:
            return self._stored(vectors, ("ord",)).withColumn("own", F.lit(True))
        rows = vectors.select("h", "ord", F.explode(F.array(*[F.lit(p) for p in range(PLACES)])).alias("place"))
        near = F.explode(F.array(*[F.lit(0), *[F.lit(1 << (15 - i)) for i in range(bits - 1)]]))
        rows = rows.withColumn("flip", near).withColumn("slot", self._slot_of(F.col("place")).bitwiseXOR(F.col("flip")))
        own = F.col("flip") == 0  # the order counts only where a vector is met, not where it asks
        return rows.select(self._part(F.col("slot")).alias("part"), "place", "h", F.when(own, F.col("ord")).alias("ord"), own.alias("own"))

    def _worth_reading(self, vectors: DataFrame, n: int) -> DataFrame:
        """Stored pages; for a batch of few vectors those with a cell that one of its probes visits,
        by a bit map of visited cells (0.2 MB whatever the data); a larger batch visits most pages."""
        pages = self.cells.read(self._gens("vectors"))
        if n * PLACES * len(FLIPS) > PLACES * 65536 // 2 or self.size < PLACES * self.page:
            return pages
        slots = vectors.select(F.explode(F.array(*[F.shiftleft(F.lit(p), 16) + self._slot_of(F.lit(p)) for p in range(PLACES)])).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, s & 63))").alias("b"))
        words = np.zeros(PLACES * 1024, np.uint64)
        for r in slots.collect():  # at most 16,384 words of bits
            words[r.w] = np.uint64(r.b & (2**64 - 1))
        at = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
        visited = np.zeros(PLACES * 65536, bool)
        visited[(at[:, None] ^ FLIPS[None, :]).ravel()] = True
        words = np.packbits(visited, bitorder="little").view(np.int64)
        upto = np.concatenate([[0], np.cumsum(words != 0)])
        seen = F.broadcast(self.spark.createDataFrame([(words.tolist(), upto.tolist())], "words array<long>, upto array<int>"))
        place, first, last = F.shiftleft("place", 10), F.shiftright("lo", 6), F.shiftright("hi", 6)
        word = lambda at: F.element_at("words", place + at + 1)
        above = F.expr("shiftleft(-1L, lo & 63)")
        below = F.expr("shiftrightunsigned(-1L, 63 - (hi & 63))")
        between = F.element_at("upto", place + last + 1) > F.element_at("upto", place + first + 2)
        ends = (word(first).bitwiseAND(above) != 0) | (word(last).bitwiseAND(below) != 0)
        hit = F.when(first == last, word(first).bitwiseAND(above).bitwiseAND(below) != 0).otherwise(between | ends)
        return pages.crossJoin(seen).filter(hit).drop("words", "upto")

    def _hot(self, new: DataFrame, n: int) -> dict[int, tuple[int, int]]:
        """Parts with more than ``split`` vectors: into how many blocks their stored vectors and their queries go."""
        if self.size + n <= self.split:
            return {}
        held = self.cells.read(self._gens("vectors")).groupBy("part").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("q"))
        loads = held.unionByName(new.groupBy("part").agg(F.count_if("own").alias("n"), F.count(F.lit(1)).alias("q"))).groupBy("part").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
        return {r.part: (-(-r.n // self.split), -(-r.q // self.split)) for r in loads.filter(F.greatest("n", "q") > self.split).collect()}  # one row per hot bucket

    def matches(self, vectors: DataFrame, n: int) -> DataFrame:
        """``vectors``: h (distinct), ord, ``n`` of them. Which meet a stored vector (old), and the neighbours
        among themselves of the others: a, b, old, more."""
        new = self._asked(vectors)
        hot = self._hot(new, n)
        pages = self._worth_reading(vectors, n)
        flags = new.withColumn("is_query", F.lit(True)).withColumnRenamed("own", "is_stored")
        if not hot:
            return self._meet(flags, pages, ["part"])
        counts = F.create_map(*[F.lit(x) for p, (i, j) in hot.items() for x in (p, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")))])
        cold = ~F.col("part").isin(list(hot))
        cool = self._meet(flags.filter(cold), pages.filter(cold), ["part"])
        blocks = lambda name: F.explode(F.sequence(F.lit(0), counts[F.col("part")][name] - 1))
        own = lambda name, *by: F.pmod(F.xxhash64(*by), counts[F.col("part")][name]).cast("int")
        warm = flags.filter(~cold)
        asked = warm.withColumn("is_stored", F.lit(False)).withColumn("j", own("j", "h")).withColumn("i", blocks("i"))
        stored = warm.filter("is_stored").withColumn("is_query", F.lit(False)).withColumn("i", own("i", "h")).withColumn("j", blocks("j"))
        paged = pages.filter(~cold).withColumn("i", own("i", "vectors")).withColumn("j", blocks("j"))
        return cool.unionByName(self._meet(asked.unionByName(stored), paged, ["part", "i", "j"]))

    def _meet(self, new: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
        # by the bucket column alone: with another beside it, Spark would shuffle the stored pages as well
        new = new.select(*by, "place", "h", "ord", "is_query", "is_stored")
        listed = self.listed
        if not self.state["vectors"]:
            none = pd.DataFrame({"place": pd.Series(dtype="int64"), "vectors": pd.Series(dtype=object)})
            return new.groupBy(*by).applyInPandas(lambda group: match_part(group, none, listed), HITS)
        return new.groupBy(*by).cogroup(pages.select(*by, "place", "vectors").groupBy(*by)).applyInPandas(lambda group, held: match_part(group, held, listed), HITS)

    # -- one batch -------------------------------------------------------------------
    def ingest(self, batch: DataFrame) -> DataFrame:
        """Decide a batch (id, batch_id, file_hash, pdq_hash) and append what is accepted:
        key, accepted, one row per id."""
        rows, n = self._kept(Workspace(self.spark, "batch"), batch_rows(batch), "rows")
        self.ingest_rows(rows, n)
        return self.decided(rows)

    def decided(self, rows: DataFrame) -> DataFrame:
        """key, accepted of rows that were ingested; a row with neither hash is always accepted."""
        known = self.accepted.read(self._gens("rows")).select("key").withColumn("known", F.lit(True))
        bare = F.col("f").isNull() & F.col("h").isNull()
        return rows.join(known, "key", "left").select("key", (F.col("known").isNotNull() | bare).alias("accepted"))

    def ingest_rows(self, rows: DataFrame, n: int) -> None:
        """As ``ingest`` for the ``n`` stored rows of ``batch_rows``."""
        if not n:
            return
        space = Workspace(self.spark, "slices")
        # all that share both hashes with an earlier row fall with it, whatever becomes of that row
        first = rows.filter("f is not null or h is not null").groupBy("f", "h").agg(F.min("ord").alias("ord"))
        first = self._unknown(first.select("ord", "f", "h"), n <= SLICE)
        bounds: list = [None]
        if n > 2 * FIRST_SLICE:
            first, n = self._kept(space, first, "first")
            bounds = self._slices(first, n)
        waiting, low = None, None
        for high in bounds:
            part = first if low is None else self._unknown(first.filter(F.col("ord") > F.lit(low)))
            part = part if high is None else part.filter(F.col("ord") <= F.lit(high))
            waiting = self._slice(space, part if waiting is None else part.unionByName(waiting), n if len(bounds) == 1 else None)
            low = high
        while waiting is not None:
            waiting = self._slice(space, self._unknown(waiting), None)
        space.drop()

    def _unknown(self, rows: DataFrame, few: bool = False) -> DataFrame:
        """Rows (ord, f, h) whose file hash is not among the accepted ones."""
        if not self.state["rows"]:
            return rows
        rows = rows.withColumn("mark", self._mark(F.col("f"), F.col("ord")))
        held = self.accepted.read(self._gens("rows")).select("mark")
        if few:  # the marks of a slice go to the stored ones, which are read once and neither sorted nor moved
            held = held.join(F.broadcast(rows.select("mark")), "mark", "left_semi")
        return rows.join(held, "mark", "left_anti").select("ord", "f", "h")

    @staticmethod
    def _kept(space: Workspace, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        """A table written and the number of its rows, in one job."""
        seen = Observation()
        kept = space.keep(rows.observe(seen, F.count(F.lit(1)).alias("n")), name)
        n = _observed(seen, "n")
        return kept, kept.count() if n is None else n

    @staticmethod
    def _slices(first: DataFrame, n: int) -> list[bytearray | None]:
        """Upper bounds (of ord, the last is open) of the slices of ``n`` rows, from a
        sample of some ten thousand rows; a slice's size is a matter of effort alone."""
        sample = first.filter(F.pmod(F.xxhash64("ord"), F.lit(max(1, n // 10_000))) == 0).select("ord", "h").collect()
        held = sorted(bytes(r.ord) for r in sample)
        vectors = _matrix([bytes(r.h) for r in sample if r.h is not None])
        loads = [np.bincount(_slot(vectors, p)).max() for p in range(PLACES)] if len(vectors) else [0]
        taken = step = FIRST_SLICE if max(loads) > min(GROUP, FIRST_SLICE // 20) else SLICE
        bounds = []
        while taken < n and held:
            bounds.append(bytearray(held[min(len(held) - 1, len(held) * taken // n)]))
            step = min(SLICE, GROWTH * taken)
            taken += step
        return [*bounds, None]

    @staticmethod
    def _mark(f: Column, key: Column) -> Column:
        """What an accepted row is stored under: its file hash, or its key where it has none."""
        return F.when(f.isNotNull(), F.concat(F.lit(bytearray(b"\x01")), f)).otherwise(F.concat(F.lit(bytearray(b"\x00")), key))

    def _slice(self, space: Workspace, rows: DataFrame, n: int | None) -> DataFrame | None:
        """Decide rows (ord, f, h), ``n`` of them, as far as their listed neighbours allow; returns those left, if any."""
        if n is None:
            rows, n = self._kept(space, rows, "slice")
        vectors = rows.filter("h is not null").groupBy("h").agg(F.min("ord").alias("ord"))
        links = self.matches(vectors, n)
        free = late = None
        if n > self.finish:
            # rows without any tie are accepted as they are, of the others the first ``finish`` are decided now
            links, n_links = self._kept(space, links, "links")
            free_shuffles(self.spark)
        if n > self.finish and n + n_links > 10 * self.finish:
            rows = rows.join(links.filter("old").select(F.col("a").alias("h")).distinct(), "h", "left_anti").select("ord", "f", "h")
            links = links.filter("not old")
            several = lambda c: rows.filter(f"{c} is not null").groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(c)
            tied_h = several("h").unionByName(links.select(F.explode(F.array("a", "b")).alias("h"))).distinct().withColumn("th", F.lit(True))
            marked = rows.join(tied_h, "h", "left").join(several("f").withColumn("tf", F.lit(True)), "f", "left")
            marked = space.keep(marked.select("ord", "f", "h", (F.col("th").isNotNull() | F.col("tf").isNotNull()).alias("tied")), "marked")
            free, rows = marked.filter("not tied").drop("tied"), marked.filter("tied").drop("tied")
            if rows.count() > self.finish:
                bound = F.lit(rows.orderBy("ord").limit(self.finish).agg(F.max("ord")).first()[0])
                rows, late = rows.filter(F.col("ord") <= bound), rows.filter(F.col("ord") > bound)
            links = links.join(rows.select(F.col("h").alias("a")).distinct(), "a", "left_semi").select("a", "b", "old", "upto")
        # one task: at most ``finish`` rows, and of each at most ``listed`` links a place; or few links of one slice
        one = lambda rows: rows.withColumn("one", F.lit(True)).groupBy("one")
        told = one(rows).cogroup(one(links)).applyInPandas(decide, "ord binary, f binary, h binary, state int")
        seen = Observation()
        told = space.keep(told.observe(seen, F.count_if(F.col("state") == 2).alias("wait")), "told")
        accepted = told.filter("state = 1").drop("state")
        self._append(accepted if free is None else free.unionByName(accepted))
        left_over = told.filter("state = 2").drop("state")
        if late is not None:
            return left_over.unionByName(late)
        return None if _observed(seen, "wait") == 0 or left_over.isEmpty() else left_over

    # -- appending -------------------------------------------------------------------
    def _commit(self) -> None:
        write_note(self.spark, self._note, self.state)

    def _generation(self) -> int:
        """A number that no write has had, noted before it is used, so that a write that broke off is never read."""
        gen = self.state["next"]
        self.state["next"] = gen + 1
        self._commit()
        return gen

    def _append(self, rows: DataFrame) -> None:
        """Add accepted rows (ord, f, h): a generation of pages and one of marks."""
        gen = self._generation()
        key = F.substring("ord", F.lit(6), F.octet_length("ord"))
        marks = rows.select(self._mark(F.col("f"), F.col("ord")).alias("mark"), key.alias("key"))
        n_rows, n_vectors = Observation(), Observation()
        marks = marks.observe(n_rows, F.count(F.lit(1)).alias("n")).repartition(self.accepted.buckets, "mark")
        vectors = rows.filter("h is not null").select("h").observe(n_vectors, F.count(F.lit(1)).alias("n"))
        with ThreadPoolExecutor(2) as pool:  # two jobs that do not wait for one another
            for job in (pool.submit(self.accepted.append, marks, gen), pool.submit(self._write_pages, vectors, gen)):
                job.result()
        sizes = {"rows": _observed(n_rows, "n"), "vectors": _observed(n_vectors, "n")}
        if sizes["rows"] is None:
            sizes["rows"] = self.accepted.read([gen]).count()
        if sizes["vectors"] is None:
            sizes["vectors"] = self.cells.read([gen]).filter("place = 0").agg(F.sum("n")).first()[0] or 0
        for kind, n in sizes.items():
            if n:
                self.state[kind][str(gen)] = n
        self._commit()
        self._grow()
        self._merge("vectors")
        self._merge("rows")

    def _write_pages(self, vectors: DataFrame, gen: int) -> None:
        page = self.page

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(pack_pages(int(group["place"].iloc[0]), int(group["part"].iloc[0]), _matrix(group["h"]), page), columns=[c.split()[0] for c in PAGES.split(", ")])

        # a hot bucket is packed in pieces of at most ``split`` vectors
        pieces = F.pmod(F.xxhash64("h"), F.lit(max(1, -(-self.size // self.split))))
        self.cells.append(self._stored(vectors).groupBy("part", "place", pieces.alias("piece")).applyInPandas(pack, PAGES), gen)

    def _merge(self, kind: str) -> None:
        """Generations of one size class become one when there are ``merge`` of them; not more at once than a
        slice or a quarter of the index holds (but two at least), as old and new ones are both on disk for a while."""
        classes: dict[int, list[int]] = {}
        for g, n in self.state[kind].items():
            classes.setdefault(int(np.log(max(n, 1)) / np.log(self.merge)), []).append(int(g))
        # generations of whole slices are few beside their size, so more of them wait
        due = [gens for c, gens in classes.items() if len(gens) >= self.merge * (4 if self.merge**c >= SLICE // self.merge else 1)]
        full = max(due, key=len, default=[])
        if not full:
            return
        held = np.cumsum([self.state[kind][str(g)] for g in full])
        full = full[: max(2, int(np.searchsorted(held, max(SLICE, sum(self.state[kind].values()) // 4), "right")))]
        n, gen = sum(self.state[kind][str(g)] for g in full), self._generation()
        if kind == "rows":
            self.accepted.append(self.accepted.read(full).repartition(self.accepted.buckets, "mark"), gen)
        else:
            page = self.page

            def merged(group: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame(pack_pages(int(group["place"].iloc[0]), int(group["part"].iloc[0]), _matrix(group["vectors"]), page), columns=[c.split()[0] for c in PAGES.split(", ")])

            # by stretches of values, so that a hot bucket is merged in pieces
            pieces = F.shiftright("lo", 16 - min(16, max(0, int(self.size // self.split).bit_length())))
            self.cells.append(self.cells.read(full).groupBy("part", "place", pieces.alias("piece")).applyInPandas(merged, PAGES), gen)
        for g in full:
            del self.state[kind][str(g)]
        self.state[kind][str(gen)] = n
        self._commit()
        (self.accepted if kind == "rows" else self.cells).discard(full)

    def _grow(self) -> None:
        """Split each bucket into four when they hold more than ``per_part`` vectors on the average."""
        if self.size <= self.per_part << self.state["bits"] or self.state["bits"] >= 12:
            return
        cells, marks, n, n_rows = self.cells, self.accepted, self.size, sum(self.state["rows"].values())
        pages = cells.read(self._gens("vectors")).filter("place = 0").select("vectors")
        held = marks.read(self._gens("rows"))

        def unpack(batches):
            for batch in batches:
                for vectors in batch["vectors"]:
                    yield pd.DataFrame({"h": [vectors[i : i + 32] for i in range(0, len(vectors), 32)]})

        gen = self._generation()
        self.state |= {"bits": self.state["bits"] + 2, "layout": gen}
        self._open_tables()
        self._write_pages(pages.mapInPandas(unpack, "h binary"), gen)
        self.accepted.append(held.repartition(self.accepted.buckets, "mark"), gen)
        self.state |= {"vectors": {str(gen): n}, "rows": {str(gen): n_rows}}
        self._commit()
        for old in (cells, marks):
            old.close()
            self.space.drop(old.path)


def batch_rows(images: DataFrame) -> DataFrame:
    """(key, b, ord, f, h): each id once. ``ord`` is the batch in five bytes that sort as numbers do, null
    first, and the key, so rows are ordered by comparing bytes."""
    rows = images.select(id_key(F.col("id")).alias("key"), F.col("batch_id").cast("int").alias("b"), F.col("file_hash").alias("f"), whole_hash(F.col("pdq_hash")).alias("h"))
    rows = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct("b", "f", "h")).alias("r")).select("key", "r.b", "r.f", "r.h")
    number = F.unhex(F.lpad(F.hex(F.coalesce(F.col("b").cast("long") + (1 << 31) + 1, F.lit(0).cast("long"))), 10, "0"))
    return rows.select("key", "b", F.concat(number, F.col("key")).alias("ord"), "f", "h")


def units(sizes: dict[int, int]) -> list[list[int]]:
    """Batches in their order, those in a row together as far as they fill a slice. ``sizes``: rows by batch."""
    out: list[list[int]] = []
    held = 0
    for no in sorted(sizes):
        if not out or held + sizes[no] > SLICE:
            out.append([])
            held = 0
        out[-1].append(no)
        held += sizes[no]
    return out


def ingest_history(spark: SparkSession, images: DataFrame, path: str | None = None, **layout) -> DataFrame:
    """Feed all batches in their order, small ones in a row together, and store each slice before the next; (id) of the duplicates.
    With ``path`` the index stays there and can be opened again; else it is deleted at the end."""
    space = Workspace(spark, "history")
    rows = batch_rows(images).select("ord", "f", "h", F.coalesce("b", F.lit(-(2**31))).alias("batch")).hint("rebalance", F.col("batch"))
    rows = space.keep(rows, "rows", ["batch"]).withColumn("key", F.substring("ord", F.lit(6), F.octet_length("ord")))
    sizes = {r.batch: r.n for r in rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per batch
    index = DedupIndex(spark, path, **{"expected": sum(sizes.values())} | layout)
    for unit in units(sizes):
        index.ingest_rows(rows.filter(F.col("batch").isin(unit)).drop("batch"), sum(sizes[no] for no in unit))
    found = index.decided(rows).filter("not accepted").select(key_text(F.col("key")).alias("id"))
    found = space.keep(found, "found")
    index.drop() if path is None else index.close()
    return found
