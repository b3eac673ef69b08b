import pathlib

from pyspark.sql import functions as F

from turnout.sources import sinks as S

TEXTS = [("1/blog.md", "# A b\n\nsecond  line é\r\nthird"), ("1/clip.mp4", "two words"), ("2/social.md", ""), ("2/social.md", "more of it"),
         ("a b%2F/youtube.md", "one"), ("3/notes.txt", "x y"), ("4/blog.md", None)]
COLUMNS = ["asset_id", "files", "bytes", "kind", "source", "words", "grounded"]


def test_packed_assets_are_listed_like_loose_ones(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "asset_id string, value string").repartition(len(TEXTS), "value")
    verdicts = spark.createDataFrame([("1/blog.md", True), ("2/social.md", False), ("gone/blog.md", True)], "asset_id string, passed boolean")
    packed, loose, both = (str(tmp_path / n) for n in ("packed", "loose", "both"))
    S.write_assets(rows, packed)
    rows.write.partitionBy("asset_id").text(loose)
    films = F.col("asset_id").endswith(".mp4")
    rows.filter(films).write.partitionBy("asset_id").text(both)
    S.write_assets(rows.filter(~films), both)

    def listed(folder):
        return {r.asset_id: tuple(r)[2:] for r in S.manifest(spark, folder, verdicts).select(*COLUMNS).collect()}
    assert listed(packed) == listed(loose) == listed(both) == {
        "1/blog.md": (len("# A b\n\nsecond  line é\r\nthird\n".encode()), "blog", "llm", 6 + 1, True), "1/clip.mp4": (10, "clip", "ffmpeg", None, None),
        "2/social.md": (12, "social", "llm", 3, False), "a b%2F/youtube.md": (4, "youtube", "llm", 1, None),
        "3/notes.txt": (4, "other", "unknown", None, None), "4/blog.md": (1, "blog", "llm", 0, None)}


def test_packs_are_not_a_file_for_each_asset(spark, tmp_path):
    S.write_assets(spark.range(500).select(F.concat("id", F.lit("/blog.md")).alias("asset_id"), F.lit("some words").alias("value")).coalesce(2), str(tmp_path / "a"))
    assert len(list(pathlib.Path(tmp_path / "a").rglob("*.parquet"))) <= 2
    out = S.manifest(spark, str(tmp_path / "a"), spark.createDataFrame([], "asset_id string, passed boolean"))
    assert [tuple(r) for r in out.agg(F.count("*"), F.sum("bytes"), F.sum("words")).collect()] == [(500, 5500, 1000)]
