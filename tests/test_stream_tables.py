"""A streamed table may be one file or a folder of files."""

from curaspark.plans import catalog_streams as Q


def test_votes_over_one_file_and_over_a_folder(spark, tmp_path):
    rows = spark.createDataFrame(
        [(c, t, "user", ("x" * 400) if t < c else "short") for c in range(5) for t in range(4)], "conv_id long, turn long, role string, text string"
    )
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "one" / "conversations.parquet")
    want = {(c, c, 4, "match" if c >= 2 else "no match") for c in range(5)}
    for layout in ("one", "many"):
        found = Q.stream_votes(spark, str(tmp_path / layout)).select("conv_id", "n_positive", "n_seen", "state").collect()
        assert {tuple(r) for r in found} == want
