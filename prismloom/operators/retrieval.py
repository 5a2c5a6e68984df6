"""Ranking metrics of queries against a gallery of labelled vectors.

A stated query set meets all rows in blocks: both sides are packed into pages of some thousand
vectors, each page of queries is scored against each of the gallery by one matrix product, and a
pair of pages gives at most its k best per query. So what is shuffled is k rows per query and
gallery page, not all pairs, and neither side passes through the driver or has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a page: a pair of pages is a product of this many rows and columns.
QUERY_PAGE, GALLERY_PAGE = 1024, 8192
PAGE = "ids binary, labels binary, vectors binary"


def _pages(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows (vec_id, embedding, label) packed: pages of at most ``size`` vectors."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), size):
                part = b.iloc[i : i + size]
                vectors = np.vstack(part["embedding"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "labels": [part["label"].to_numpy(np.int32).tobytes()], "vectors": [vectors.tobytes()]})

    packed = rows.select("vec_id", "embedding", "label").filter("embedding is not null").mapInPandas(pack, PAGE)
    return packed.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("ids", "labels", "vectors")])


def nearest(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """Both: vec_id, embedding, label. The k most similar gallery rows of each query by dot
    product, ties by vec_id, the query itself left out: query_id, query_label, doc_id, doc_label, sim, rank."""
    schema = "query_id long, query_label int, doc_id long, doc_label int, sim double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                own, docs = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.g_ids, np.int64)
                own_labels, doc_labels = np.frombuffer(r.q_labels, np.int32), np.frombuffer(r.g_labels, np.int32)
                sims = np.frombuffer(r.q_vectors).reshape(len(own), -1) @ np.frombuffer(r.g_vectors).reshape(len(docs), -1).T
                sims[own[:, None] == docs[None, :]] = -np.inf
                take = min(k, sims.shape[1])
                # ties at the edge of the k best are all kept; the rank below breaks them
                edge = -np.partition(-sims, take - 1, axis=1)[:, take - 1]
                q, d = np.nonzero((sims >= edge[:, None] - 1e-12) & np.isfinite(sims))
                yield pd.DataFrame({"query_id": own[q], "query_label": own_labels[q], "doc_id": docs[d], "doc_label": doc_labels[d], "sim": sims[q, d]})

    pairs = _pages(gallery, GALLERY_PAGE, "g").crossJoin(_pages(queries, QUERY_PAGE, "q"))
    scored = pairs.mapInPandas(score, schema)
    # rounding makes the order the same however a product was summed
    order = Window.partitionBy("query_id").orderBy(F.round("sim", 9).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def metrics_at(ranked: DataFrame, n_queries: int, ks: list[int]) -> DataFrame:
    """recall (share of queries with a hit), MRR (mean over queries that have a hit) and mAP (mean
    over all ranks 1..k of hits so far by rank, over all queries) for each k."""
    hit = (F.col("query_label") == F.col("doc_label")).cast("int")
    upto = Window.partitionBy("query_id").orderBy("rank")
    rows = ranked.select("query_id", "rank", hit.alias("hit")).withColumn("hits", F.sum("hit").over(upto))
    per_k = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    per_query = rows.select("*", per_k).filter("rank <= k").groupBy("k", "query_id").agg(F.max("hit").alias("any"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), (F.sum(F.col("hits") / F.col("rank")) / F.col("k")).alias("ap"))
    return per_query.groupBy("k").agg(F.round(F.sum("any") / n_queries, 6).alias("recall"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"), F.round(F.sum("ap") / n_queries, 6).alias("map"))


def topk_accuracy(ranked: DataFrame, n_queries: int, k: int) -> DataFrame:
    """Percent of queries whose label is among the labels of the k nearest."""
    hits = ranked.filter(F.col("rank") <= k).filter("query_label = doc_label").select("query_id").distinct()
    return hits.agg(F.round(100.0 * F.count(F.lit(1)) / n_queries, 4).alias("accuracy"))
