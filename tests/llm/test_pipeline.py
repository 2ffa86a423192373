"""The pipeline's stages on small tables, each against what it must leave."""

from collections import Counter

import corpus_pipeline as pipeline
from tests.llm.corpus import edge_rows, random_texts
from tests.llm.test_operators import brute_components, brute_contaminated, labelled, sets_of


def test_stages(spark, tmp_path):
    rows, labels = labelled(spark, 200)
    item = " ".join(f"q{k}" for k in range(40))
    extra = [*random_texts(20, 4), "start " + item, 'a password = "abc123456" b ' + rows[3][1]]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in [*rows, *((1000 + k, t) for k, t in enumerate(extra))]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = frame.columns
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in held.collect()}
        stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/out/{k}")
        held = spark.read.parquet(f"{tmp_path}/out/{k}")
        after = {r.doc_id: r for r in held.collect()}
        assert k == 4 or held.columns == columns
        if k == 0:
            assert set(after) < set(before) and not {i for i in after if i < 200 and i % 7 == 0}
        elif k == 1:
            roots = brute_components(sets_of([(i, r.text) for i, r in before.items()], 5), 80)
            assert set(after) == {i for i in before if roots[i] == i}
        elif k == 2:
            hit = {i for i, _ in brute_contaminated([(i, r.text) for i, r in before.items() if i >= 1000], [(1, item)])}
            assert set(after) == set(before) - hit
        elif k == 3:
            assert set(after) == set(before) and not any("abc123456" in r.text for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert set(after) <= set(before) and {"epoch", "block", "position", "key"} <= set(held.columns)
    assert set(pipeline.run(spark, str(tmp_path)).columns) == {*columns, "epoch", "block", "position", "key"}


def test_rows_that_share_an_id_are_compared_by_text(spark, tmp_path):
    words = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, words("a"), "s"), (5, words("a"), "s"), (5, words("b"), "s"), (5, words("b"), "t"), (7, words("c"), "s"), (None, words("a"), "s"), (None, None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in pipeline.similar(spark, frame, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, words("a")), (5, words("b")), (7, words("c")), (None, words("a")), (None, None)], key=str)


def test_mixing_emits_only_the_rows_it_took(spark, tmp_path):
    rows = [(9, f"{k} " + "x" * 400, "big", k) for k in range(40)] + [(None, f"{k} " + "y" * 400, "small", k) for k in range(4)] + [(9, "same", "small", k) for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    out = pipeline.mixing(spark, frame, str(tmp_path)).collect()
    taken = pipeline.mix_sources(frame).groupBy("source", "epoch").count().collect()
    assert {(r.source, r.epoch): r["count"] for r in taken} == dict(Counter((r.source, r.epoch) for r in out))
    assert max(Counter((r.source, r.text, r.n, r.epoch) for r in out).values()) == 1


def test_stages_keep_columns_of_any_name_and_take_edge_rows(spark, tmp_path):
    names = "other_id long, taken_id long, epoch string, key string, position int, block int, found_id long, found_rk long, row string, row_key long, nth int, rk long, own_id long, number long"
    fill = tuple(x if kind == "string" else 7 for _, kind in (c.split() for c in names.split(", ")) for x in ["x"])
    rows = [(i, t, "en", s, len(t or "")) + fill for i, t, _, s in edge_rows()]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    spark.createDataFrame([(5, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data, folder in ((frame, "some"), (frame.limit(0), "none"), (frame.filter("doc_id is null"), "nulls")):
        held = data
        for k, (_, stage) in enumerate(pipeline.STAGES):
            stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/{folder}/{k}")
            held = spark.read.parquet(f"{tmp_path}/{folder}/{k}")
            if k < 4:
                assert held.columns == frame.columns
        assert {*held.columns} == {*frame.columns} and (folder != "none" or held.count() == 0)
    kept = Counter((r.doc_id, r.text) for r in pipeline.similar(spark, frame, str(tmp_path)).collect() if r.doc_id is not None)
    assert max(kept.values()) == 1 and (6, rows[7][1]) not in kept and (5, rows[6][1]) in kept
