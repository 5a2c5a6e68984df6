"""Wide tables, orphan references and shredding on small hand-made rows."""

from datetime import datetime

from pyspark.sql import functions as F

from prismloom.operators import eav, orphans, shred

SA = "id string, name string, sequence_id string, value_float float, value_json string, created_at timestamp_ntz, extra string"
UUID = "00000000-0000-0000-0000-00000000000{}".format


def at(day):
    return None if day is None else datetime(2024, 1, day)


def types(spark):
    return spark.createDataFrame([("clip_score", "float"), ("object_count", "integer"), ("is_usable", "boolean"), ("scene_tag", "string")], "name string, value_type string")


def cells(spark, rows):
    table = eav.load_wide(spark, spark.createDataFrame(rows, SA), types(spark))
    return {(r.sequence_id, r.name): r.annotation_id for r in table.cell_sources().collect()}


def test_latest_version_wins_and_ties_go_by_id(spark):
    rows = [
        (UUID(1), "clip_score", "s", 0.5, None, at(2), None),
        (UUID(2), "CLIP-Score ", "s", 0.7, None, at(3), None),
        (UUID(3), "clip score", "s", 0.9, None, at(3), None),
        (UUID(4), "clip_score", "s", 0.1, None, None, None),
        (UUID(4), "clip_score", "s", 0.1, None, None, None),
    ]
    assert cells(spark, rows) == {("s", "clip_score"): UUID(3)}
    assert cells(spark, rows[3:]) == {("s", "clip_score"): UUID(4)}


def test_readable_values(spark):
    cases = [
        ("clip_score", float("nan"), None, False), ("clip_score", float("inf"), "1", False), ("clip_score", None, " 1.5e2 ", True),
        ("clip_score", None, '"  -3 "', True), ("clip_score", None, '{"score": 2}', True), ("clip_score", None, '{"score": "2"}', False),
        ("clip_score", None, "[1]", False), ("clip_score", None, "NaN", False), ("object_count", 2.0, None, True), ("object_count", 2.5, None, False),
        ("object_count", None, '"3.0"', True), ("is_usable", 1.0, None, True), ("is_usable", 0.5, None, False), ("is_usable", None, '"YES"', True),
        ("is_usable", None, '"maybe"', False), ("is_usable", None, "false", True), ("scene_tag", None, '"x"', True), ("scene_tag", None, '"  "', False),
        ("scene_tag", 1.0, '"x"', False), ("scene_tag", None, "x", False), ("unknown", 1.0, None, False), (None, 1.0, None, False),
    ]
    rows = [(UUID(1), name, f"s{i}", vf, vj, at(1), None) for i, (name, vf, vj, _) in enumerate(cases)]
    rows.append((UUID(1), "clip_score", None, 1.0, None, at(1), None))
    assert {s for s, _ in cells(spark, rows)} == {f"s{i}" for i, c in enumerate(cases) if c[3]}


def test_typed_columns_upsert_and_compaction(spark):
    table = eav.WideTable(spark, eav.attributes_of(types(spark)))
    make = lambda *rows: spark.createDataFrame(rows, SA)
    table.upsert(make((UUID(1), "clip_score", "a", 0.5, None, at(1), None), (UUID(2), "object_count", "a", None, "4", at(1), None)))
    table.upsert(make((UUID(3), "is_usable", "a", None, "true", at(2), None), (UUID(4), "scene_tag", "b", None, '"x"', at(2), None)))
    table.upsert(make((UUID(5), "clip_score", "a", 0.25, None, at(3), None)))
    table.upsert(spark.createDataFrame([], SA))
    before = {tuple(r) for r in table.read().collect()}
    assert len(table.runs) == 3  # an empty batch leaves no run
    table.compact(whole=True)
    assert len(table.runs) == 1
    after = {tuple(r) for r in table.read().collect()}
    assert before == after == {("a", 0.25, True, 4, None), ("b", None, None, None, "x")}
    assert dict(table.read().dtypes) == {"sequence_id": "string", "clip_score": "double", "is_usable": "boolean", "object_count": "bigint", "scene_tag": "string"}


def test_wide_table_opens_again_and_keeps_the_newest(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, SA)
    path = f"file://{tmp_path}/wide"
    table = eav.WideTable(spark, eav.attributes_of(types(spark)), path, fan=2)
    table.upsert(make((UUID(1), "object_count", "a", None, "9007199254740993", at(5), None), (UUID(2), "clip_score", "b", 0.5, None, at(2), None)))
    table.close()
    again = eav.WideTable(spark, eav.attributes_of(types(spark)), path, fan=2)
    # an old value that arrives late loses, a newer one wins; a number of more than 64 bits is a cell without value
    again.upsert(make((UUID(3), "object_count", "a", None, "1", at(1), None), (UUID(4), "clip_score", "b", 0.25, None, at(3), None), (UUID(5), "object_count", "c", 1e30, None, at(1), None)))
    assert len(again.runs) == 2
    again.compact()
    assert len(again.runs) == 1
    assert {(r.sequence_id, r.clip_score, r.object_count) for r in again.read().collect()} == {("a", None, 9007199254740993), ("b", 0.25, None), ("c", None, None)}
    assert {(r.sequence_id, r.annotation_id) for r in again.cell_sources().collect()} == {("a", UUID(1)), ("b", UUID(4)), ("c", UUID(5))}


def test_compaction_moves_no_row(spark):
    table = eav.WideTable(spark, eav.attributes_of(types(spark)))
    for day in (1, 2):
        table.upsert(spark.createDataFrame([(UUID(day), "clip_score", "a", 0.5, None, at(day), None)], SA))
    merged = table.merged()
    merged.collect()
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()


def tables(spark, elements=(), labels=(), images=(), annotations=(), creators=(), deleted=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return {
        "sample_annotation_elements": frame(elements, "sample_annotation_id string, element_id string, element_type string, role string, created_at timestamp_ntz, at string"),
        "annotations": frame(labels, "id string, creator_id string, created_at timestamp_ntz"),
        "lance_images": frame(images, "id string, ingested_at timestamp_ntz"),
        "texts": frame([], "id string, ingested_at timestamp_ntz"),
        "sample_annotations": frame(annotations, "id string, created_at timestamp_ntz"),
        "creators": frame(creators, "id string, created_at timestamp_ntz"),
        "deleted_ids": frame(deleted, "entity_table string, entity_id string, deleted_at timestamp_ntz"),
    }


def test_orphan_statuses(spark):
    i = UUID
    t = tables(
        spark,
        elements=[
            (i(1), i(5).upper(), " Image", "a", at(5), None),
            (i(1), "0x" + i(6).replace("-", ""), "image", "a", at(5), None),
            (i(1), i(7), "image", "b", at(5), None),
            (i(1), i(7), "image", "b", at(1), None),
            (i(1), i(8), "image", "c", at(5), None),
            (i(1), i(9), "image", "d", None, None),
            (i(1), "none", "text", "e", at(5), None),
            (i(1), None, "text", "f", at(5), None),
            (i(1), i(4), "video", "g", at(5), None),
        ],
        labels=[(i(2), i(3), at(4)), (i(3), None, at(4))],
        images=[(i(5), at(1)), (i(7), at(3)), (i(8), at(2)), (i(9), at(9))],
        creators=[],
        deleted=[("lance_images", i(8), at(3)), ("lance_images", i(5), at(1)), ("lance_images", i(9), at(8))],
    )
    found = {(r.ref_table, r.role, r.target_id, r.period, r.status) for r in orphans.find_orphans(spark, t).collect()}
    assert found == {
        ("sample_annotation_elements", "a", i(5), "2024-01", "deleted"),
        ("sample_annotation_elements", "a", i(6), "2024-01", "missing"),
        ("sample_annotation_elements", "b", i(7), "2024-01", "late"),
        ("sample_annotation_elements", "c", i(8), "2024-01", "deleted"),
        ("sample_annotation_elements", "e", "none", "2024-01", "missing"),
        ("annotations", "creator", i(3), "2024-01", "missing"),
    }


def test_orphan_cascade_ends_on_cycles(spark):
    i = UUID
    link = lambda a, b: (i(a), i(b), "sample_annotation", "about", at(5), None)
    t = tables(spark, elements=[(i(1), i(9), "image", "x", at(5), None), link(2, 1), link(3, 2), link(2, 3), link(6, 7)], annotations=[(i(n), at(1)) for n in (1, 2, 3, 6, 7)])
    found = {(r.ref_id, r.target_id, r.status) for r in orphans.render(orphans.cascade(spark, t)).collect()}
    assert found == {(i(1), i(9), "missing"), (i(2), i(1), "inherited"), (i(3), i(2), "inherited"), (i(2), i(3), "inherited")}
    assert orphans.find_orphans(spark, tables(spark)).count() == 0


def test_status_report_counts_late_references(spark):
    i = UUID
    link = lambda a, b, day: (i(a), i(b), "sample_annotation", "about", at(day), None)
    t = tables(
        spark,
        # 1 is late and orphans nothing (2 is sound); 3 is missing, 4 inherits and is late as well
        elements=[(i(1), i(5), "image", "x", at(2), None), link(2, 1, 9), (i(3), i(6), "image", "x", at(2), None), link(4, 3, 2)],
        images=[(i(5), at(3))],
        annotations=[(i(1), at(1)), (i(2), at(1)), (i(3), at(4)), (i(4), at(1))],
    )
    found = {(r.period, r.status): r.n for r in orphans.orphan_report(spark, t).collect()}
    assert found == {("2024-01", "late"): 2, ("2024-01", "missing"): 1, ("2024-01", "inherited"): 1}
    listed = {(r.period, r.status): r["count"] for r in orphans.find_orphans(spark, t).groupBy("period", "status").count().collect()}
    assert listed == {k: n for k, n in found.items() if k[1] != "inherited"}


SEQ = (
    "sequence_id string, create_time timestamp_ntz, path string, sequence_choices array<struct<choice:array<struct<type:string,index:string,require_loss:boolean,ref_index:string>>>>,"
    " images array<struct<id:string,width:int,height:int,index:string>>, texts array<struct<id:string,content:string,language:string,index:string>>"
)


def test_shredding_links_items_to_members(spark):
    item = lambda kind, index: (kind, index, None, None)
    rows = [
        ("a", at(1), "p", [([item("image", "old")],)], None, None),
        ("a", at(2), "p", [None, ([None, item("image", "x"), item(None, "y"), item("text", "x"), item("image", None)],), (None,)], [("i1", 1, 1, "x"), ("i2", 1, 1, "x"), None, ("i3", 1, 1, "y")], [("t1", "c", "en", "y")]),
        ("b", at(1), "p", [], [], []),
        ("b", at(1), "p", [], [], []),
        ("c", None, "p", None, None, None),
    ]
    flat = shred.shred(shred.latest_export(spark.createDataFrame(rows, SEQ)), ["sequence_id"], "seq")
    assert set(flat) == {"seq", "seq_sequence_choices", "seq_sequence_choices_choice", "seq_images", "seq_texts"}
    assert flat["seq"].count() == 3 and flat["seq_sequence_choices"].count() == 3 and flat["seq_images"].filter("is_null").count() == 1
    assert {r.parent_path for r in flat["seq_sequence_choices_choice"].collect()} == {"2"}
    found = sorted((r.sequence_id, r.choice_no, r.item_no, r.element_id) for r in shred.resolve_members(flat).collect())
    assert found == [("a", 2, 2, "i1"), ("a", 2, 2, "i2"), ("a", 2, 3, "i3"), ("a", 2, 3, "t1"), ("a", 2, 4, ""), ("a", 2, 5, "")]


def test_shredding_inlines_shares_and_clashes(spark):
    schema = "id string, path string, a struct<b:struct<c:int>, path:string>, xs array<struct<path:string, n:int>>, more struct<xs:array<struct<path:string,n:int>>>, m map<string,int>, nested array<array<int>>"
    rows = [("k", "p", ((1,), "q"), [("u", 1)], ([("v", 2)],), {"z": 3}, [[1, 2], None])]
    flat = shred.shred(spark.createDataFrame(rows, schema), ["id"], "r")
    assert flat["r"].columns == ["id", "path", "a_b_c", "a_path"]
    shared = sorted((r.parent_table, r.xs_path, r.n) for r in flat["r_xs"].collect())
    assert shared == [("r", "u", 1), ("r", "v", 2)]
    assert [(r.map_key, r.value) for r in flat["r_m"].collect()] == [("z", 3)]
    assert sorted((r.path, r.value) for r in flat["r_nested_item"].collect()) == [("1.1", 1), ("1.2", 2)]


def test_recursive_elements_share_one_table(spark):
    schema = "id string, kids array<struct<n:int, kids:array<struct<n:int>>>>"
    flat = shred.shred(spark.createDataFrame([("k", [(1, [(2,), (3,)])])], schema), ["id"], "r")
    assert sorted((r.parent_table, r.path, r.n) for r in flat["r_kids"].collect()) == [("r", "1", 1), ("r_kids", "1.1", 2), ("r_kids", "1.2", 3)]


def test_hot_entity(spark):
    hot = spark.range(20000).select(F.format_string("00000000-0000-0000-0000-%012d", "id").alias("id"), F.lit("clip_score").alias("name"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("sequence_id"), F.lit(0.5).cast("float").alias("value_float"), F.lit(None).cast("string").alias("value_json"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    found = eav.load_wide(spark, hot, types(spark)).cell_sources()
    assert found.count() == 1 + 20000 - 6667
    assert found.filter("sequence_id = 'hot'").first().annotation_id.endswith("19998")
