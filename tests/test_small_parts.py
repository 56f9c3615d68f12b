"""Sources, sinks, orders, names and labels on small tables and real folders."""

import json

from pyspark.sql import functions as F

from curaspark.functions import text as X
from curaspark.functions import vec as V
from curaspark.operators import agg as A
from curaspark.operators import cluster as C
from curaspark.operators import history as H
from curaspark.operators import order as O
from curaspark.sources import media as M
from curaspark.sources import sinks as K


def test_listing_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.jpg", "b.PNG", "c.txt", "deep/d.webp", "deep/e.mp4", "f.gif"):
        (tmp_path / name).write_bytes(b"x" * len(name))

    def names(**how):
        return sorted(r.path.split("/")[-1] for r in M.scan_media(spark, str(tmp_path), **how).collect())

    assert names() == ["a.jpg", "b.PNG", "d.webp"] and names(recursive=False) == ["a.jpg", "b.PNG"]
    assert names(videos=True, gifs=True) == ["a.jpg", "b.PNG", "d.webp", "e.mp4", "f.gif"] and names(exts=[".txt"]) == ["c.txt"]
    row = M.scan_media(spark, str(tmp_path)).filter(F.col("path").endswith("d.webp")).first()
    assert row.size == len("deep/d.webp") and row.base_dir == str(tmp_path) and row.path == str(tmp_path / "deep" / "d.webp")


def test_file_lists_and_marks(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps(["/m/a.png", "/m/b.png", "/n/a.png"]))
    listed = M.from_file_list(spark, str(tmp_path / "list.json"))
    assert sorted(r.path for r in listed.collect()) == ["/m/a.png", "/m/b.png", "/n/a.png"]
    K.export_marks(listed, str(tmp_path / "marks"))
    K.export_marks(listed, str(tmp_path / "marks_json"), as_text=False)
    names = spark.read.text(str(tmp_path / "marks")).withColumnRenamed("value", "name").unionByName(spark.createDataFrame([("gone.png",)], "name string"))
    found = K.import_marks(listed, names)
    assert {(r.name, r.n_found, r.path) for r in found.collect()} == {("a.png", 2, "/m/a.png"), ("b.png", 1, "/m/b.png"), ("gone.png", 0, None)}
    assert tuple(K.import_summary(found).first()) == (2, 1)
    assert spark.read.json(str(tmp_path / "marks_json")).count() == 3


def test_reports_and_snapshots(spark, tmp_path):
    stats, messages = spark.createDataFrame([(3,)], "n long"), spark.createDataFrame([("x", 2)], "message string, n long")
    K.write_report(stats, messages, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/stats")).first().n == 3 and spark.read.json(str(tmp_path / "report/messages")).first().message == "x"
    for version, rows in ((1, [(1, 0)]), (2, [(1, 0), (2, 0)])):
        K.snapshot(spark.createDataFrame(rows, "id long, group_id long"), str(tmp_path / "snap"), version)
    assert K.restore(spark, str(tmp_path / "snap"), 1).count() == 1 and K.restore(spark, str(tmp_path / "snap"), 2).count() == 2


def test_preferences_of_directories(spark):
    media = spark.createDataFrame([("/a/x", "/a"), ("/b/y", "/b"), ("/c/z", None)], "path string, directory string")
    prefs = spark.createDataFrame([("/a", "size"), ("/z", "name")], "directory string, sort_by string")
    got = {r.path: r.sort_by for limit in (10, 0) for r in M.profiles(media, prefs, max_rows=limit).collect()}
    assert got == {"/a/x": "size", "/b/y": None, "/c/z": None}


def test_orders(spark):
    rows = [("/m/b10.png", 3, 9, 10, 40, 7, "/o/2"), ("/m/b9.jpg", 1, 8, 30, 20, 7, "/o/1"), ("/k/C1.png", 2, 7, 20, 20, 5, "/o/3")]
    media = spark.createDataFrame(rows, "path string, ctime long, mtime long, width long, height long, size long, origin string")
    b10, b9, c1 = (r[0] for r in rows)
    want = {
        "full_path": [c1, b10, b9], "name": [b9, b10, c1], "ctime": [b9, c1, b10], "mtime": [c1, b9, b10], "type": [b9, c1, b10], "size": [c1, b10, b9],
        "name_length": [c1, b9, b10], "pixels": [c1, b10, b9], "height": [c1, b9, b10], "width": [b10, c1, b9], "related": [b9, b10, c1],
    }
    for by, paths in want.items():
        assert [r.path for r in O.sort_media(media, by).collect()] == paths, by
        assert [r.path for r in O.positions(media, by).orderBy("pos").collect()] == paths, by
    assert [r.path for r in O.sort_for_run(media, "ctime", desc=True).collect()] == [b10, c1, b9]
    assert sorted(r.path for r in O.sort_for_run(media).collect()) == sorted(r[0] for r in rows)
    placed = O.positions(media, "related")
    assert O.first_at_or_after(placed, F.col("origin"), F.lit("/o/2")).first().path == b10  # closest by related
    assert O.first_at_or_after(placed, F.col("origin"), F.lit("/o/9")).count() == 0


def test_random_orders_repeat(spark):
    media = spark.createDataFrame([(f"/m/{i}",) for i in range(200)], "path string")
    orders = [[r.path for r in O.shuffle(media.repartition(n), 7).collect()] for n in (1, 5)]
    assert orders[0] == orders[1] and sorted(orders[0]) == sorted(r.path for r in media.collect()) and orders[0] != sorted(orders[0])
    assert orders[0] != [r.path for r in O.shuffle(media, 8).collect()]
    assert O.sample_one(media, 7).first().path == orders[0][0]
    scored = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.6)], "id long, score double")
    assert {r.id for r in O.within_threshold(scored, 0.6).collect()} == {2} and {r.id for r in O.within_threshold(scored, 0.6, lower=True).collect()} == {1, 3}


def test_free_names(spark):
    rows = [(i, n) for i, n in enumerate(["a.png"] * 4 + ["a_2.png", "b.png", "b.png", "c"])]
    held = spark.createDataFrame([(0, "b.png"), (0, "a_3.png")], "k long, name string")
    out = H.free_names(spark.createDataFrame(rows, "k long, name string"), "name", [F.col("k")], held).orderBy("k").collect()
    final = [r.final_name for r in out]
    assert len(set(final)) == len(final) and not {"b.png", "a_3.png"} & set(final)
    # wanted names that are free stay, the others are numbered in row order around names that are taken
    assert final == ["a.png", "a_1.png", "a_4.png", "a_5.png", "a_2.png", "b_1.png", "b_2.png", "c"]


def test_labels_and_signatures(spark):
    scores = spark.createDataFrame([(0.97,), (0.9,), (0.5,)], "s double")
    assert [r.x for r in scores.select(V.match_label("s", 0.95, 0.85).alias("x")).collect()] == ["duplicate", "probable", "similar"]
    assert [r.x for r in scores.select(V.match_label("s", 0.6, 0.95, False).alias("x")).collect()] == ["similar", "probable", "duplicate"]
    rules = [{"name": "a", "limit": 1}, {"name": "b", "is_active": False}]
    assert A.policy_signature(rules) == A.policy_signature([{"limit": 1, "name": "a"}]) != A.policy_signature([{"name": "a", "limit": 2}])
    assert [r.t for r in spark.createDataFrame([(None,), ("x",)], "t string").select(X.ensure_str("t").alias("t")).collect()] == ["", "x"]


def test_supergroup_parts(spark):
    groups = spark.createDataFrame([(i, g, 0.5) for i, g in enumerate([0, 0, 1, 1, 1, 2, 2, 3, 3, 3, 3])], "id long, group_id long, score double")
    supers = spark.createDataFrame([(0, 0, 5), (1, 0, 5), (2, 1, 2), (9, 1, 2)], "group_id long, supergroup_id long, n_items long")
    live = C.prune_supergroups(supers, groups)
    assert sorted(r.group_id for r in live.collect()) == [0, 1, 2]
    assert C.meaningful(live).first().meaningful is True and C.meaningful(live.filter("supergroup_id = 1")).first().meaningful is False
    # by the supergroup's total, then the group's own size; groups without one last
    assert [r.group_id for r in C.sorted_groups(groups, live, desc=True).orderBy("position").collect()] == [1, 0, 2, 3]
    assert [r.group_id for r in C.sorted_groups(groups, live).orderBy("position").collect()] == [2, 0, 1, 3]


def test_frame_slots(spark):
    items = spark.createDataFrame([("a", 3), ("b", 1), (None, 2)], "path string, n int")
    assert [(r.path, r.slot) for r in M.frames(items, "path", F.col("n")).orderBy("path", "slot").collect()] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
