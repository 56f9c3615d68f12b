"""Cases that fixed limits once cut off."""

import json

from pyspark.sql import functions as F

from curaspark.functions import meta, paths
from curaspark.sources import media, sinks
from curaspark.streaming import streams


def test_conditioning_chains_are_followed_to_the_end(spark):
    def graph(hops, wildcards=()):
        nodes = {"1": {"class_type": "KSampler", "inputs": {"positive": ["10", 0], "negative": ["2", 0]}}}
        nodes["2"] = {"class_type": "CLIPTextEncode", "inputs": {"text": "bad"}}
        for i in range(hops):
            nodes[str(10 + i)] = {"class_type": "Relay", "inputs": {"conditioning": [str(11 + i), 0]}}
        nodes[str(10 + hops)] = {"class_type": "CLIPTextEncode", "inputs": {"text": "good"}}
        for i, text in enumerate(wildcards):
            nodes[str(900 + i)] = {"class_type": "ImpactWildcardProcessor", "inputs": {"populated_text": text}}
        return json.dumps(nodes)

    cycle = json.loads(graph(3))
    cycle["12"]["inputs"]["conditioning"] = ["10", 0]
    rows = [(0, graph(0)), (1, graph(9)), (2, graph(40)), (3, graph(2, ("first", "last"))), (4, json.dumps(cycle))]
    got = {r.id: (r.positive, r.negative) for r in meta.workflow_prompts(spark.createDataFrame(rows, "id int, wf string"), "id", "wf").collect()}
    assert got == {0: ("good", "bad"), 1: ("good", "bad"), 2: ("good", "bad"), 3: ("last", "bad"), 4: ("", "bad")}


def test_names(spark):
    names = ["a.png", "x/a.ogv", "x/y/b.opus", "/c.wv", "d/e.m4b"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select(
        "path", paths.dirname("path").alias("dir"), paths.media_type("path").alias("kind")
    ).collect()
    assert [(r.dir, r.kind) for r in rows] == [("", "image"), ("x", "video"), ("x/y", "audio"), ("", "audio"), ("d", "audio")]


def test_long_parts_make_one_stem(spark):
    first, second, third = "a" * 5, "b" * 505, "c" * 20
    stem = f"{first}_{second}_{third}"
    got = spark.createDataFrame([(f"{stem}.png",)], "path string").select(paths.base_stem("path")).first()[0]
    assert got == f"{first}_{second}"


def test_every_recent_name_is_exempt(spark):
    recent = spark.range(500).select(F.col("id").cast("string").alias("basename"))
    rows = spark.range(600).select(F.col("id").cast("string").alias("name"))
    flagged = streams.exempt_stream(rows, recent, F.col("name"))
    assert flagged.filter("exempt").count() == 500 and flagged.count() == 600


def test_purge_has_no_upper_bound(spark):
    store = spark.range(90_000).select(F.concat(F.lit("p"), "id").alias("path"))
    found = spark.range(25_000).select(F.concat(F.lit("p"), "id").alias("path"))
    assert sinks.purge_stale(store, found).count() == 25_000


def test_result_of_another_folder(spark, tmp_path):
    inputs = spark.createDataFrame([("a",)], "path string")
    assert sinks.load_result(spark, inputs, str(tmp_path / "none")) is None
    sinks.save_result(inputs, inputs, str(tmp_path / "some"))
    assert sinks.load_result(spark, inputs, str(tmp_path / "some")).count() == 1


def test_gathering_in_every_order(spark):
    rows = [(f"r{k}/{n}", f"r{k}", s, w, h) for k in range(8) for n, s, w, h in (("b_long_name.png", 3, 5, 1), ("a.gif", 1, 2, 9), ("cc.jpg", 2, 3, 3))]
    table = spark.createDataFrame(rows, "path string, base_dir string, size int, width int, height int")
    orders = ["name", "size", "type", "name_length", "pixels", "width", "height", "full_path"]
    prefs = spark.createDataFrame([(f"r{k}", o, k % 2 == 1) for k, o in enumerate(orders)], "base_dir string, sort_by string, descending boolean")
    got: dict = {}
    for r in media.gather_sorted(table, prefs).orderBy("pos").collect():
        got.setdefault(r.base_dir, []).append(r.path.split("/")[1])
    names = ["a.gif", "b_long_name.png", "cc.jpg"]
    keys = {
        "name": lambda n: n, "full_path": lambda n: n, "size": lambda n: {"b": 3, "a": 1, "c": 2}[n[0]], "type": lambda n: n[-3:],
        "name_length": len, "pixels": lambda n: {"b": 5, "a": 18, "c": 9}[n[0]], "width": lambda n: {"b": 5, "a": 2, "c": 3}[n[0]],
        "height": lambda n: {"b": 1, "a": 9, "c": 3}[n[0]],
    }
    for k, o in enumerate(orders):
        assert got[f"r{k}"] == sorted(names, key=keys[o], reverse=k % 2 == 1)
