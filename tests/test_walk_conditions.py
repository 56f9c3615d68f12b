"""Walks whose conditions need other rows, named by type and loaded from JSON."""

from curaspark.plans.decision import DecisionWalk


def _walk(*conditions):
    nodes = [
        {
            "name": f"n{i}", "condition": c, "on_match": {"outcome_type": "EXECUTE_AND_CONTINUE", "action_type": "MOVE", "action_modifier": f"m{i}"},
            "on_no_match": {"outcome_type": "CONTINUE"},
        }
        for i, c in enumerate(conditions)
    ]
    return DecisionWalk.from_dict({"name": "w", "nodes": nodes, "category_map": {"art": "_art"}})


def test_joined_conditions_run_from_json(spark):
    walk = _walk(
        {"condition_type": "classifier_rank", "classifier_name": "k", "categories": ["art"], "min_confidence": 0.5},
        {"condition_type": "classifier_rank", "classifier_name": "k", "inherit_categories": True, "max_rank": 2},
        {"condition_type": "base_stem_match", "search_directory": "pool", "suffix_filter": ["_edit"]},
        {"condition_type": "base_stem_match", "search_directory": "pool", "require_match": False},
        {"condition_type": "unknown_suffix", "search_directory": "pool", "expected_suffixes": ["_edit"]},
        {"condition_type": "composite", "operator": "AND", "sub_conditions": [
            {"condition_type": "filename_contains", "patterns": ["rose"]},
            {"condition_type": "base_stem_match", "search_directory": "pool", "suffix_filter": ["_edit"]},
        ]},
    )
    assert walk.validate() == []
    files = [("w/rose_17820172251234.png",), ("w/lily_29134560782345.png",), ("w/aster_99134560782345.png",)]
    df = spark.createDataFrame(files, "path string")
    pool = spark.createDataFrame([("p/rose_17820172251234_edit.png",), ("p/lily_29134560782345_odd.png",)], "path string")
    preds = spark.createDataFrame(
        [(files[0][0], "art", 0.9, 0), (files[0][0], "photo", 0.1, 1), (files[1][0], "art", 0.4, 0), (files[1][0], "photo", 0.6, 1)],
        "path string, category string, score double, ord int",
    )
    ready = walk.prepare(df, {"k": preds}, {"pool": pool})
    got = {r.path.split("/")[1][:4]: [x.modifier for x in r.fired] for r in walk.run(ready).collect()}
    assert got == {"rose": ["m0", "m1", "m2", "m5"], "lily": ["m1", "m4"], "aste": ["m3"]}
    again = DecisionWalk.from_dict(walk.to_dict())
    assert again.to_dict() == walk.to_dict()


def test_errors_of_conditions():
    bad = _walk(
        {"condition_type": "no_such_type"},
        {"condition_type": "classifier_rank", "categories": ["a"], "min_rank": 3, "max_rank": 2},
        {"condition_type": "classifier_rank"},
        {"condition_type": "filename_contains", "patterns": [" "]},
        {"condition_type": "unknown_suffix"},
        {"condition_type": "related_image"},
    )
    assert len(bad.validate()) == 6
