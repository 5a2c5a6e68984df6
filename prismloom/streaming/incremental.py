"""Continuous versions of resume and merge with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import first_per_key
from ..plans.storage import exists


def resume_stream(spark: SparkSession, source: str, schema: str, output: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], key: str = "key", available_now: bool = True):
    """Every new file of ``source`` is read once; rows whose key the output already has are left
    out, the rest is processed and appended. A batch that runs again after a failure finds its own
    keys in the output and adds nothing twice."""

    def handle(batch: DataFrame, _: int) -> None:
        fresh = first_per_key(batch, [key], [F.xxhash64(*batch.columns)])
        try:
            done = spark.read.parquet(output).select(key)
        except Exception as missing:  # the first batch has no output yet
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        else:
            fresh = fresh.join(done, key, "left_anti")
        process(fresh).write.mode("append").parquet(output)

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def apply_with_result(rows: DataFrame, fn: Callable[[dict], object], key: str, workers: int = 8, retries: int = 2, result_type: str = "string", delay: float = 0.0) -> DataFrame:
    """A Python function (such as a service call) over each row, with a thread pool per task:
    key, result of ``result_type``, error. A failing row is tried again after ``delay`` seconds and then
    gives its error, never a failed job."""
    kind = dict(rows.dtypes)[key]
    as_text = result_type == "string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from concurrent.futures import ThreadPoolExecutor

        def one(row: dict) -> tuple:
            error = None
            for attempt in range(retries + 1):
                if attempt and delay:
                    time.sleep(delay)
                try:
                    value = fn(row)
                    return row[key], str(value) if as_text and value is not None else value, None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
            return row[key], None, error

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch.to_dict("records"))), columns=["k", "result", "error"])

    return rows.mapInPandas(run, f"k {kind}, result {result_type}, error string").withColumnRenamed("k", key)


def run_annotator(spark: SparkSession, rows: DataFrame, output: str, fn: Callable[[dict], object], result_type: str = "string", key: str = "key", workers: int = 8, retries: int = 2, delay: float = 0.0) -> dict[str, int]:
    """Annotate the rows whose key ``output`` does not have yet, each key once, and append key, result and
    error there. A key stored with an error is done as well. Returns how many rows there were, were
    skipped, succeeded and failed; a broken-off run is resumed by calling this again."""
    from pyspark.sql import Observation

    fresh = first_per_key(rows, [key], [F.xxhash64(*rows.columns)])
    if exists(spark, output):
        fresh = fresh.join(spark.read.parquet(output).select(key), key, "left_anti")
    seen = Observation()
    made = apply_with_result(fresh, fn, key, workers, retries, result_type, delay)
    made.observe(seen, F.count(F.lit(1)).alias("done"), F.count("error").alias("failed")).write.mode("append").parquet(output)
    total, (done, failed) = rows.count(), (seen.get["done"], seen.get["failed"])
    return {"total": total, "skipped": total - done, "succeeded": done - failed, "failed": failed}


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, *groups: str) -> DataFrame:
    """Counts per time window with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *groups).agg(F.count(F.lit(1)).alias("n"))
