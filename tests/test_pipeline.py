import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliospark.operators.chunking import ChunkConfig
from foliospark.plans import pipeline
from foliospark.streaming import runs

TEXT = "A sentence with enough words to find keywords in it. Machine learning systems need data."


def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id bigint, text string")


def test_run(spark):
    c = pipeline.ExtractionConfig.from_dict({"chunking": {"max_characters": 40, "overlap": 5}, "keywords": {"algorithm": "rake"}, "language_detection": True, "token_reduction": "light"})
    out = {r["id"]: r for r in pipeline.run_pipeline(docs(spark), c).collect()}
    assert out[1]["detected_languages"] == ["eng"] and out[1]["quality_score"] > 0.9 and out[1]["keywords"] and len(out[1]["chunks"]) > 1 and out[1]["warnings"] == []
    assert out[2]["content"] is None and out[2]["chunks"] is None and "empty content" in out[3]["warnings"]


def test_plugins(spark):
    shout = pipeline.Processor("shout", lambda df, _: df.withColumn("content", F.upper("content")), "late")
    first = pipeline.Processor("first", lambda df, _: df.withColumn("content", F.concat("content", F.lit("!"))), "early", 90)
    r = pipeline.Registry([shout, first], [pipeline.Validator("long", lambda: F.length("content") > 5, abort=False)])
    assert [p.name for p in r.active(pipeline.ExtractionConfig())] == ["first", "shout"]
    assert r.active(pipeline.ExtractionConfig(enabled_processors=("shout",), disabled_processors=("shout",))) == [shout]
    out = {x["id"]: x for x in pipeline.run_pipeline(docs(spark), registry=r).collect()}
    assert out[1]["content"] == TEXT.upper() + "!" and "validator long failed" in out[3]["warnings"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.unknown").write_text("?")
    import zipfile

    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in.txt", "inside")
    rows = {r["path"].rsplit("/", 1)[-1]: r["result"] for r in pipeline.extract_files(spark, str(tmp_path)).collect()}
    assert rows["a.csv"]["tables"] == [[["x", "y"], ["1", "2"]]] and rows["b.unknown"]["error"] and rows["b.unknown"]["content"].startswith("Error:")
    inner = pipeline.unpack(pipeline.extract_files(spark, str(tmp_path), "*.zip"), 2).where("depth = 1").first()
    assert inner["path"].endswith("c.zip!in.txt") and inner["result"]["content"] == "inside"


def test_cache(spark):
    df = spark.createDataFrame([(bytearray(b"a"), "text/plain"), (bytearray(b"b"), None)], "content binary, mime_type string")
    c = pipeline.ExtractionConfig()
    todo, _ = pipeline.cached_results(df, None, c)
    assert todo.count() == 2
    done = todo.limit(1).select("cache_key", F.lit("r").alias("result"))
    left, hit = pipeline.cached_results(df, done, c)
    assert left.count() == 1 and hit.count() == 1
    assert c.merged({"token_reduction": "light", "output_format": None}).token_reduction == "light"


def test_stream_gives_the_batch_result(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "in"))
    c = pipeline.ExtractionConfig(chunking=ChunkConfig(40, 5))
    stream = runs.stream_documents(spark, str(tmp_path / "in"), "doc_id bigint, text string")
    runs.start(stream, c, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["id"]: r["chunks"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["id"]: r["chunks"] for r in pipeline.run_pipeline(docs(spark), c).collect()}
    seen = []
    runs.for_each_result(stream, c, lambda df, k: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination(120)
    assert sum(seen) == 3


def test_stages_see_earlier_results(spark):
    """Late processors see quality and keywords, and only the rows they apply to."""
    late = pipeline.Processor("mark", lambda df, _: df.withColumn("content", F.concat(F.lit("good: "), "content")), "late", applies=lambda: F.col("quality_score") > 0.5)
    log = []
    started = pipeline.Processor("hooks", lambda df, _: df, initialize=lambda: log.append("up"), shutdown=lambda: log.append("down"))
    with pipeline.Registry([late, started]) as r:
        out = {x["id"]: x["content"] for x in pipeline.run_pipeline(docs(spark), registry=r).collect()}
    assert out == {1: f"good: {TEXT}", 2: None, 3: ""} and log == ["up", "down"]


def test_aborting_validator_ends_the_run(spark):
    r = pipeline.Registry([], [pipeline.Validator("never", lambda: F.length("content") > 999)])
    with pytest.raises(Exception, match="validator never failed"):
        pipeline.run_pipeline(docs(spark), registry=r).select("id").collect()


def test_output_format_and_overrides(spark):
    df = spark.createDataFrame([(1, "# Head\n\nBody & more", None), (2, "# Head\n\nBody", '{"output_format": "html", "include_elements": true}'), (3, "a  b", '{"token_reduction": "light", "enable_quality_processing": false}')], "doc_id bigint, text string, o string")
    out = {r["id"]: r for r in pipeline.run_with_overrides(df, F.col("o")).collect()}
    assert out[1]["content"] == "# Head\n\nBody & more" and out[2]["content"] == "<h1>Head</h1>\n<p>Body</p>" and [e["kind"] for e in out[2]["elements"]] == ["heading", "paragraph"] or out[2]["elements"]
    assert out[3]["reduced"] == "a b" and out[3]["quality_score"] is None and out[1]["reduced"] is None
    assert pipeline.run_with_overrides(df.limit(0), F.col("o")).count() == 0


def test_batch_in_order_with_timeout(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "a.txt").write_text("one")
    paths = [str(tmp_path / n) for n in ("b.txt", "missing.txt", "a.txt", "b.txt")]
    rows = pipeline.extract_batch(spark, paths).orderBy("ordinal").collect()
    assert [r["path"] for r in rows] == paths and [r["result"]["error"] is None for r in rows] == [True, False, True, True]
    assert [r["result"]["content"] for r in rows if r["result"]["error"] is None] == ["two", "one", "two"]
    assert pipeline.extract_batch(spark, ["/nowhere/x.txt"]).first()["result"]["error"]
    with pytest.raises(TimeoutError), pipeline.deadline(0.05):
        while True:
            pass


def test_result_cache(spark, tmp_path):
    cache = pipeline.ResultCache(spark, str(tmp_path / "cache"), ttl=100)
    df = spark.createDataFrame([("k1", 5, 7), ("k2", 6, 8), ("k3", 1, None)], "cache_key string, size bigint, modified bigint")
    todo, hit = cache.split(df, 1000)
    assert todo.count() == 3 and hit.count() == 0 and cache.cleanup(10**6) == 0
    cache.write(df.withColumn("result", F.lit("r")), 1000)
    cache.write(df.where("cache_key = 'k2'").withColumn("result", F.lit("new")), 1050, ttl=1000)
    todo, hit = cache.split(df, 1090)
    assert todo.count() == 0 and {r["cache_key"]: r["result"] for r in hit.collect()} == {"k1": "r", "k2": "new", "k3": "r"}
    changed = df.withColumn("size", F.col("size") + F.when(F.col("cache_key") == "k1", 1).otherwise(0))
    assert [r[0] for r in cache.split(changed, 1090)[0].select("cache_key").collect()] == ["k1"]
    assert {r["cache_key"] for r in cache.split(df, 1101)[1].collect()} == {"k2"} and cache.split(df, 1090, "other")[1].count() == 0
    assert cache.stats().first()["n"] == 4
    assert cache.cleanup(10**6) == 1 and cache.valid(1000).count() == 0


def test_entry(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "p6_found" in names
    assert entry.entry(spark).count() > 0
