"""Write rules, reads by selector, streams of samples and files."""

import io
import tarfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prismloom.functions import imaging
from prismloom.functions import text as tx
from prismloom.operators import reader, retrieval, sampling, scores, sequencing, stats, store, training
from prismloom.queries import registries
from prismloom.sources import files, tar
from prismloom.streaming import incremental

ENTRIES = {n: e for r in registries() for n, e in r.entries.items()}


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# -- who wins -----------------------------------------------------------------------
def test_priorities(spark):
    target = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    new = spark.createDataFrame([(1, "b1", 1, 1), (1, "b2", 2, 1), (1, "b2later", 2, 2), (3, "f1", 1, 1), (3, "f1later", 1, 2), (3, "f2", 2, 0)], "id int, v string, b int, o int")
    assert rows_of(store.batch_dedup(new.filter("b = 2"), ["id"], "o"), "id", "v") == [(1, "b2"), (3, "f2")]
    assert rows_of(store.upsert_replace(target, new, ["id"], "b", "o"), "id", "v") == [(1, "b2"), (2, "old"), (3, "f2")]
    merged = store.merge_ignore(target, new, ["id"], "b", "o")
    assert rows_of(merged, "id", "v") == [(1, "old"), (2, "old"), (3, "f1")]
    assert rows_of(store.merge_ignore(merged, new, ["id"], "b", "o"), "id", "v") == rows_of(merged, "id", "v")


def test_flattening_sequences(spark):
    label = [("tag", None, "me", None)]
    rows = [
        ("s", "u1", None, [("s", "i1", bytearray(b"x"), 1, 2, "index_0", label), ("s", "i1", bytearray(b"x"), 1, 2, "index_1", None)], [("s", "t1", "hello", "en", "caption", None)], label),
        ("s", "u2", None, None, [], None),
    ]
    flat = store.flatten_sequences(spark.createDataFrame(rows, store.SEQUENCE))
    sizes = {n: t.count() for n, t in flat.items()}
    assert sizes == {"sequences": 2, "images": 1, "image_blobs": 1, "texts": 1, "sequence_images": 2, "sequence_texts": 1, "creators": 1, "annotations": 2, "image_annotations": 1, "text_annotations": 0, "sequence_annotations": 1}
    assert flat["annotations"].filter("creator_id is null").count() == 0
    assert all(len(r.id) == 36 for r in flat["images"].collect())


def test_sample_annotation_ids_ignore_sequence_and_value(spark):
    who = [("e1", "image", "target")]
    schema = "name string, creator_name string, creator_meta string, sequence_id string, value string, participants array<struct<element_id:string,element_type:string,role:string>>"
    rows = [("n", "c", None, "s1", "0.5", who), ("n", "c", None, "s2", "0.7", who), ("n", "c", None, "s1", '{"a": 1}', None), ("m", "c", None, "s1", "true", None)]
    out = store.sample_annotation_rows(spark.createDataFrame(rows, schema))
    assert out["sample_annotations"].count() == 3 and out["creators"].count() == 1 and out["sample_annotation_elements"].count() == 1
    assert {(r.value_float, r.value_json) for r in out["sample_annotations"].filter("name = 'm'").collect()} == {(1.0, None)}


def test_binding(spark):
    items = spark.createDataFrame([("a", "s", "index_0"), ("a", "s", "index_1"), ("b", None, None)], "id string, sequence_id string, index string")
    every, bridge = store.bind_items(items, "image")
    assert every.count() == 2 and bridge.columns == ["sequence_id", "image_id", "index"] and bridge.count() == 2
    labels = spark.createDataFrame([("l", "image", "i"), ("m", "text", "t"), ("n", "other", "o")], "id string, type string, element_id string")
    every, img, txt = store.bind_annotations(labels)
    assert (every.count(), img.count(), txt.count()) == (3, 1, 1)


def test_converted_ids(spark):
    raw = bytearray(range(16))
    df = store.convert_ids(spark.createDataFrame([(raw, [(raw, b"x")], raw)], "id binary, parts array<struct<a_id:binary,data:binary>>, blob binary"))
    row = df.first()
    assert row.id == "00010203-0405-0607-0809-0a0b0c0d0e0f" == row.parts[0].a_id and row.parts[0].data == b"x" and bytes(row.blob) == bytes(raw)


# -- reads --------------------------------------------------------------------------
@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items") / "a")
    names = "ABACBACBAC"
    df = spark.createDataFrame([(i, i, f"id{i}", f"item_{i}", names[i]) for i in range(10)], "pos long, row_id long, id string, name string, category string")
    df.write.parquet(path)
    return path


def test_take(spark, items):
    r = reader.Reader(spark)
    assert r.count(items) == 10
    names = lambda **kw: [x.name for x in r.take(reader.Ref(items, **kw)).collect()]
    assert names(columns=["name"], indices=[4, 0, 2], keep_order=True) == ["item_4", "item_0", "item_2"]
    assert sorted(names(indices=[4, 0, 2, 2, 99])) == ["item_0", "item_2", "item_4"]
    assert len(names(query={"category": ["A"]})) == 4 and len(names(query={"category": ["A", "B"]})) == 7
    assert names(ids=["id7", "id3"], keep_order=True) == ["item_7", "item_3"]
    assert r.take(reader.Ref(items, columns=["name"], query={"category": ["A"]})).columns == ["name", "category"]
    assert names(row_ids=[]) == []
    with pytest.raises(ValueError):
        r.take(reader.Ref(items))
    with pytest.raises(KeyError):
        r.take(reader.Ref(items, columns=["absent"], ids=["id1"]))
    both = r.take_all([reader.Ref(items, ["id"], indices=[1]), reader.Ref(items, ["id"], indices=[1, 2])])
    assert both.count() == 2 and r.take_all([]) is None
    with pytest.raises(ValueError):
        r.take_all([reader.Ref(items, ["id"], indices=[1]), reader.Ref(items, ["id"], ids=["id1"])])
    with pytest.raises(ValueError):
        r.take_all([reader.Ref(items, ["id"], indices=[1]), reader.Ref(items, ["name"], indices=[1])])


def test_positions(spark):
    df = reader.with_positions(spark.range(1000).select(F.col("id")).repartition(7), ["id"])
    assert df.filter("id <> pos").count() == 0


# -- streams of samples -------------------------------------------------------------
def test_runs_and_members(spark):
    rows = spark.createDataFrame([("s", i, g) for i, g in enumerate("aabbbaN".replace("N", "c"))], "s string, o int, g string")
    runs = sequencing.run_groups(rows, "s", ["o"], "g", 2)
    assert [(r.run_no, r.chunk_no) for r in runs.orderBy("o").collect()] == [(1, 0), (1, 0), (2, 0), (2, 0), (2, 1), (3, 0), (4, 0)]
    files_ = [("u", 0, "d/x.PNG"), ("u", 1, "d/x.json"), ("u", 2, "d/y.png"), ("u", 3, "d/x.png")]
    df = spark.createDataFrame([(u, o, f, bytearray(b"1")) for u, o, f in files_], "url string, offset long, fname string, data binary")
    assert sorted((r.key, sorted(r.members)) for r in sequencing.group_members(df).collect()) == [("d/x", ["json", "png"]), ("d/x", ["png"]), ("d/y", ["png"])]
    twice = df.unionByName(spark.createDataFrame([("u", 4, "d/x.png", bytearray(b"2"))], df.schema))
    with pytest.raises(Exception, match="duplicate suffix"):
        sequencing.group_members(twice).collect()


def test_filters_and_routes(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", None)], "k string, v double")
    assert rows_of(df.filter(sequencing.in_range({"v": (1, 4)}, df.columns)), "k") == [("a",)]
    assert rows_of(df.filter(sequencing.in_range({"v": (1, 4), "w": (0, 1)}, df.columns, True)), "k") == [("a",), ("c",)]
    kept, seen = sequencing.counted_filter(df, F.col("v") > 2, "one")
    assert kept.count() == 1 and seen.get == {"seen": 3, "passed": 1}
    assert sequencing.route(df, F.col("k"), {"a": lambda r: r, "b": lambda r: r, "c": lambda r: r}).count() == 3
    with pytest.raises(Exception, match="no route"):
        sequencing.route(df, F.col("k"), {"a": lambda r: r}).collect()
    side = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "k string, s int")
    assert rows_of(sequencing.attach(df.na.fill(0), side, "k", "x_"), "k", "x_s") == sorted([("a", 1), ("b", None), ("c", None)], key=str)
    dup = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 3)], "k string, o int")
    assert rows_of(sequencing.odd_keys(dup, "k", "o"), "k", "o") == [("a", 3), ("b", 1)]
    assert rows_of(sequencing.unique_keys(dup, "k"), "k") == [("b",)]


# -- parsing ------------------------------------------------------------------------
def one(spark, col, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(col(F.col("x"))).collect()]


def test_text_functions(spark):
    assert one(spark, tx.first_sentence, " a b . c", None, "　x") == ["a b", "", "x"]
    parsed = one(spark, tx.score_and_reason, "7@ok", "12 @ far", "@x", "5@", None, '```json\n{"OVERALL": {"score": 3, "reason": "r"}}\n```', '{"OVERALL": {"score": 3}}')
    assert [p and tuple(p) for p in parsed] == [(7, "ok"), (10, "far"), None, None, None, (3, "r"), None]
    assert one(spark, tx.float_score, "7.5@x", "-1@", "nan@x", "x", "11@") == [7.5, 0.0, None, None, 10.0]
    assert one(spark, tx.extract_json, ' {"a":1} ', 'x {"a":1} y', "none", "```\n{}\n```") == ['{"a":1}', '{"a":1}', None, "{}"]
    assert one(spark, tx.pick_prompts, '["a", " ", null]', '{"2":"y","1":"x"}', "x", None) == [["a"], ["x", "y"], None, None]
    assert one(spark, lambda c: tx.with_style(c, "S."), "a", "a!") == ["a. S.", "a! S."]
    assert one(spark, tx.image_urls, "![x](http://h/a.png) http://h/a.png http://h/b.jpg") == [["http://h/a.png", "http://h/b.jpg"]]
    assert one(spark, tx.clean_caption, '"A  watercolor of x ,y"', "水彩风格", None, "ab, " * 80) == ["A of x, y", "水彩风格", "", ("ab, " * 60)[:-2]]
    assert one(spark, tx.unfence_lines, "```json\nx\n```", "x") == ["x", "x"]
    assert one(spark, tx.minimum_pixels, "image size must be at least about 3686400 px", "no") == [3686400, None]
    assert [tuple(p) for p in one(spark, tx.label_pair, "COMMON: a\nLABEL: 0", '{"label": 0, "common": "b"}')] == [("a", 0), ("b", 0)]
    assert tx.truth_text("Yes") and not tx.truth_text("0") and tx.role_of_column("image_id") == "image"
    order = spark.createDataFrame([("index_10",), ("index_2",), ("caption",), ("",), (None,)], "i string").orderBy(*tx.natural_order(F.col("i")))
    assert [r.i for r in order.collect()] == ["index_2", "index_10", "caption", None, ""] or [r.i for r in order.collect()][:3] == ["index_2", "index_10", "caption"]


def test_style_goes_on_every_caption(spark, tmp_path):
    blanks = "\u3000\u00a0\u2003\u0085\u2028\n\x0b"
    cases = [("en", "a cat", "a cat. "), ("en", f"{blanks}a cat!{blanks}", "a cat! "), ("zh", f"一只猫。{blanks}", "一只猫。. "), ("EN", "née\nLee?", "née\nLee? "), (None, "“x” ", "“x”. "), ("en-US", blanks, ". ")]
    rows = [(str(i), language, content) for i, (language, content, _) in enumerate(cases)] + [("null", "en", None)]
    spark.createDataFrame(rows, "id string, language string, content string").write.parquet(str(tmp_path / "texts.parquet"))
    entry = ENTRIES["style_suffix"]
    found = {r.id: r.prompt for r in entry.run(spark, str(tmp_path)).collect()}
    assert found == {str(i): f"{start}Keep the style." for i, (_, _, start) in enumerate(cases)}
    with duckdb.connect() as con:
        con.execute(f"create view texts as select * from '{tmp_path}/texts.parquet/*.parquet'")
        assert dict(con.execute(entry.sql).fetchall()) == found


def test_scores(spark):
    raw = ["1", "[1, {\"score\": 3}, \"x\"]", '{"score": 5}', '{"a": 1, "b": {"score": 3}}', "true", "null", '"x"']
    assert one(spark, scores.numbers_in, *raw) == [[1.0], [1.0, 3.0], [5.0], [1.0, 3.0], [1.0], [], []]
    flat = '{"choices": [{"logprobs": {"top_logprobs": [{"1": -0.1, "0": -2.0}]}}]}'
    assert one(spark, lambda c: F.round(scores.probability_of_one(scores.top_logprobs(c)), 4), flat) == [0.8699]
    done = spark.createDataFrame([("a", None)], "key string, score double")
    assert rows_of(scores.remaining(spark.createDataFrame([("a",), ("b",)], "key string"), done), "key") == [("b",)]


def test_histogram_and_stats_of_odd_columns(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,), (float("nan"),)], "v double")
    assert sum(r.n for r in stats.equal_width_histogram(df, "v", 4).collect()) == 2
    assert stats.equal_width_histogram(df.limit(0), "v").count() == 0
    img = spark.createDataFrame([(None, 2, 1), ("a", 2, 0)], "source string, width int, height int")
    out = {(r.source, r.is_total): r for r in stats.image_stats(img).collect()}
    assert set(out) == {(stats.TOTAL, 0), (stats.TOTAL, 1)} and out[(stats.TOTAL, 0)].std_width is None


def test_retrieval_is_monotone(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ranked = retrieval.nearest(df.filter("vec_id < 6"), df, 10)
    recall = {r.k: r.recall for r in retrieval.metrics_at(ranked, 6, [1, 5, 10]).collect()}
    assert recall[1] <= recall[5] <= recall[10]
    best = {r.query_id: r.doc_id for r in ranked.filter("rank = 1").collect()}
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    for q_id, d_id in best.items():
        s = m @ m[q_id]
        s[q_id] = -np.inf
        assert d_id == int(s.argmax())


def test_training_records(spark):
    schema = "sequence_id string, images array<struct<id:string,width:int,height:int,index:string>>, texts array<struct<id:string,content:string,language:string,index:string>>"
    rows = [("a", [("i", 1, 1, "source"), ("j", 1, 1, "target"), ("k", 1, 1, "other"), None], [("t", "c", "en", "instruction_en")]), ("b", None, None), ("c", [("i", 1, 1, "source")], [("t", "c", "en", "instruction_en")])]
    made = training.training_choices(spark.createDataFrame(rows, schema), ["instruction_en", "instruction_cn"])
    assert [(r.sequence_id, len(r.images), len(r.sequence_choices)) for r in made.collect()] == [("a", 2, 1)]
    assert [tuple(r) for r in training.validate_records(made).collect()] == [("a", 1, 3, 0)]


def test_pairs_are_unique_and_balanced(spark):
    contents = spark.createDataFrame([(f"c{i}",) for i in range(5)], "content string")
    styles = spark.createDataFrame([(f"s{i}",) for i in range(3)], "style string")
    prompts = spark.createDataFrame([(f"c{i}", f"p{j}") for i in range(5) for j in range(4)], "content string, prompt string")
    got = sampling.balanced_pairs(contents, styles, prompts, 4, 3).collect()
    assert len({r.pair for r in got}) == len(got) and len({(r.content, r.prompt) for r in got}) == len(got)
    assert got == sampling.balanced_pairs(contents, styles, prompts, 4, 3).collect()


# -- files --------------------------------------------------------------------------
def test_tar_round_trip(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name, data in (("x/1.jpg", b"\xff\xd8\xff1"), ("__meta__", b"m"), ("x/__h__/2.txt", b"h"), ("x/1.txt", b"cap")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    members = tar.read_tar(spark, str(tmp_path))
    assert rows_of(members, "fname") == [("x/1.jpg",), ("x/1.txt",)]
    assert tar.first_images(members, 1).first().out_name == "1.jpg"
    rows = spark.createDataFrame([(f"k{i}", bytearray(b"\x89PNG"), "c") for i in range(5)] + [("none", None, "c")], "key string, image binary, caption string")
    out = tar.write_tar(rows, str(tmp_path / "out"), per_shard=3)
    assert sum(r.n for r in out.collect()) == 5
    again = tar.read_tar(spark, str(tmp_path / "out"))
    assert again.filter("fname like '%.png'").count() == 5


def test_captions_of_every_language_are_tarred(spark, tmp_path):
    texts = {"a": ("zh", "一只猫"), "b": ("ZH", "猫"), "c": ("en", "née"), "d": (None, "x\ny"), "e": ("zh-CN", ""), "f": ("en", None)}
    spark.createDataFrame([(i, *t) for i, t in texts.items()], "id string, language string, content string").write.parquet(str(tmp_path / "texts.parquet"))
    found = rows_of(ENTRIES["tar_round_trip"].run(spark, str(tmp_path)), "fname", "size")
    assert found == [(f"{i}.txt", len(c.encode())) for i, (_, c) in texts.items() if c is not None]


def test_imports_and_commits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sequence_id": "s", "value": 1}\nbroken\n{"sequence_id": null, "value": 2}\n')
    good, bad = files.import_annotations(spark, str(tmp_path / "a.jsonl"), "jsonl")
    assert good.count() == 1 and bad.count() == 2
    (tmp_path / "m.json").write_text('{"a": 1, "b": {"score": 2}}')
    assert rows_of(files.keyed_json(spark, str(tmp_path / "m.json")), "dataset", "key") == [("m", "a"), ("m", "b")]
    for i in range(3):
        spark.createDataFrame([(2 * i, "x"), (2 * i + 1, "y")], "id long, v string").write.parquet(str(tmp_path / f"st{i}"))
    target = str(tmp_path / "ds")
    assert files.staged_commit(spark, [str(tmp_path / f"st{i}") for i in range(3)], target) == 6
    with pytest.raises(Exception):
        files.staged_commit(spark, [str(tmp_path / "st0"), str(tmp_path / "absent")], target)
    assert spark.read.parquet(target).count() == 6
    (tmp_path / "v" / "images").mkdir(parents=True)
    (tmp_path / "v" / "metadata.db").write_text("")
    (tmp_path / "v" / "store.toml").write_text('tags = ["x"]\n[indexes]\n"image:source" = "first"\n')
    assert files.discover_stores(str(tmp_path)) == [str(tmp_path / "v")]
    config = files.store_config(str(tmp_path / "v" / "store.toml"))
    assert config["indexes"] == [{"type": "image", "name": "source", "description": "first"}] and files.is_valid_store(config, {"x"}, "p")


def test_rows_survive_every_format(spark, tmp_path):
    values = ['{"a": "x, y"}', '"quoted"', " blanks ", "two\nlines\r\nmore", "back\\slash \\", "", None, "猫", "null", '"']
    rows = spark.createDataFrame([(f"s{i}", v, None if v is None else i / 3) for i, v in enumerate(values)], "sequence_id string, value string, score float")
    for fmt in ("csv", "jsonl", "parquet"):
        files.write_rows(rows, str(tmp_path / fmt), fmt)
        assert sorted(files.read_rows(spark, str(tmp_path / fmt), fmt, rows.schema).collect()) == sorted(rows.collect()), fmt
    good, bad = files.import_annotations(spark, str(tmp_path / "csv"), "csv")
    assert rows_of(good, "sequence_id", "value") == [(f"s{i}", v) for i, v in enumerate(values) if v is not None]
    assert rows_of(bad, "sequence_id") == [("s6",)]


def test_resume_stream(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "key string, v int"
    run = lambda: incremental.resume_stream(spark, src, schema, out, ckpt, lambda b: b.withColumn("v", F.col("v") * 10)).awaitTermination()
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema).write.parquet(src)
    run()
    spark.createDataFrame([("b", 9), ("c", 3)], schema).write.mode("append").parquet(src)
    run()
    assert rows_of(spark.read.parquet(out), "key", "v") == [("a", 10), ("b", 20), ("c", 30)]


def test_results_and_errors(spark):
    def half(row):
        return 1 // row["n"]

    out = incremental.apply_with_result(spark.createDataFrame([("a", 1), ("b", 0)], "key string, n int"), half, "key")
    got = {r.key: (r.result, r.error is None) for r in out.collect()}
    assert got == {"a": ("1", True), "b": (None, False)}


def test_image_features():
    rgb = np.zeros((32, 32, 3), np.uint8)
    rgb[:, 16:] = 255
    f = imaging.features(rgb, b"raw")
    assert f["entropy"] == 1.0 and f["edge_probability"] > 0.8 and f["edge_near_patch_min_std"] == 0.0
    assert imaging.hamming(b"\x00\xff", b"\x01\xff") == 1


def test_annotator_resumes_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 4), ("c", 4)], "key string, n int")
    share = lambda r: 8.0 / r["n"]
    out = str(tmp_path / "out")
    assert incremental.run_annotator(spark, rows.limit(2), out, share, "double", retries=0) == {"total": 2, "skipped": 0, "succeeded": 1, "failed": 1}
    # a key with an error is done, a repeated key is taken once
    assert incremental.run_annotator(spark, rows, out, share, "double", retries=1) == {"total": 4, "skipped": 3, "succeeded": 1, "failed": 0}
    got = {r.key: (r.result, r.error) for r in spark.read.parquet(out).collect()}
    assert got["a"] == (8.0, None) and got["c"] == (2.0, None) and got["b"][0] is None and got["b"][1].startswith("ZeroDivisionError")


def test_sample_transforms_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, None, "y")], "__key__ int, a string, b string")
    kept = sequencing.map_samples(rows, lambda s: None if s["a"] is None else {"c": s["a"] * 2}, "c string")
    assert [tuple(r) for r in kept.collect()] == [(1, "xx")]
    assert sequencing.map_samples(rows.limit(0), lambda s: s, "c string").count() == 0
    assert [r.l for r in rows.select(sequencing.as_list(rows, ["b", "gone", "a"]).alias("l")).collect()] == [[None, None, "x"], ["y", None, None]]
    assert sequencing.assign(rows, n=F.col("a").try_cast("int"), m=F.col("n").isNull()).select("m").distinct().first().m
    mixed = sequencing.interleave(spark.range(20).withColumnRenamed("id", "k"), 4, "k", 3)
    assert sorted(r.turn for r in mixed.collect()) == list(range(20))


def test_json_is_canonical(spark):
    texts = ['{"b": 1, "a": [1.0, "é"]}', "no json", None, "[]", '{"a": {"d": null, "c": true}}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.j for r in rows.select(tx.canonical_json(F.col("t")).alias("j")).collect()] == ['{"a":[1.0,"é"],"b":1}', None, None, "[]", '{"a":{"c":true,"d":null}}']
