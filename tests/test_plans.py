"""What the physical plans must look like to hold at scale."""

import os

import pytest

from pyspark.sql import functions as F

from prismloom.operators import eav, orphans, shred
from prismloom.operators.store import StoreViews
from prismloom.plans.skew import HEAVY_SHARE, join_by_weight
from prismloom.queries import registries

FOLDER = "/root/testdata/sf0.001"
RUN = {n: q for r in registries() for n, q in r.queries().items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(RUN["take_by_query"](spark, FOLDER))
    assert "PushedFilters: [In(source" in text and "pdq_hash" not in text
    text = plan(RUN["range_filter"](spark, FOLDER))
    assert "GreaterThanOrEqual(width,512)" in text and "file_hash" not in text


@pytest.mark.parametrize("name", ["stat_sequences", "sequence_view", "image_text_pairs", "score_by_source", "p2_found", "p6_found", "merge_ignore", "orphan_images"])
def test_no_product_of_sides(spark, name):
    text = plan(RUN[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_latest_rows_are_pruned_before_the_shuffle(spark):
    text = plan(shred.latest_export(StoreViews(spark, FOLDER)._read("sequences_data")))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_references_are_reduced_before_they_meet(spark):
    tables = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("sample_annotation_elements", "annotations", "lance_images", "texts", "sample_annotations", "creators", "deleted_ids")}
    text = plan(orphans.direct_orphans(orphans.references(tables["sample_annotation_elements"], tables["annotations"]), orphans.target_states({t: tables[t] for t in orphans.TABLES}, tables["deleted_ids"])))
    assert "partial_min" in text and "Python" not in text


def test_cells_stay_in_the_jvm(spark):
    rows = spark.read.parquet(f"{FOLDER}/sample_annotations.parquet")
    text = plan(eav.read_cells(rows, eav.attributes_of(spark.read.parquet(f"{FOLDER}/attribute_types.parquet")), F.lit(0)))
    assert "Python" not in text and "hashpartitioning" not in text


def test_heavy_keys_are_few_and_nothing_is_lost(spark):
    rows = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n")
    joined = join_by_weight(rows, keyed, "k", "n", 9000)
    assert joined.count() == 9000 and joined.filter("k = 0").count() == 3000
    assert keyed.filter(f"n > {9000 * HEAVY_SHARE}").count() <= 1 / HEAVY_SHARE
