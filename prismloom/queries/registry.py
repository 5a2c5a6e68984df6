"""Named queries: a Spark callable and, where SQL can say it, the DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: tuple[str, ...]


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def add(self, name: str, sql: str | None = None, covers: str = "") -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.entries:
                raise ValueError(f"query {name} exists")
            self.entries[name] = Entry(fn, sql.strip() if sql else None, tuple(covers.split()))
            return fn

        return keep

    def queries(self) -> dict[str, Query]:
        return {n: e.run for n, e in self.entries.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {n: e.sql for n, e in self.entries.items() if e.sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
