import datetime

import pytest
from pyspark.sql import functions as F

from skein.__main__ import main
from skein.functions.providers import HashingEmbedder, embed_in_batches, service_url, shortened, vectors_of, with_embeddings, with_retries
from skein.plans import stored
from skein.plans import generate
from skein.plans.config import build, dotenv, load, merged
from skein.plans.config import Config
from skein.streaming.streams import folded_state, fresh, steps


def upper():
    class Upper:  # local, so that workers get it by value
        name = "upper"

        def generate(self, prompts):
            return [p.upper() if p != "none" else None for p in prompts]

    return Upper()


def test_batches():
    sizes = []

    class Limited:
        def embed(self, texts):
            if len(texts) > 10:
                raise ValueError("batch is larger than 10")
            sizes.append(len(texts))
            return [[1.0]] * len(texts)

    assert len(embed_in_batches(Limited(), ["x"] * 21)) == 21 and sizes == [10, 10, 1]
    waits = []
    with pytest.raises(ZeroDivisionError):
        with_retries(lambda: 1 / 0, 5, 0.5, 2.0, waits.append)
    assert waits == [0.5, 1.0, 2.0, 2.0]
    assert service_url("http://x:1/v1/") == "http://x:1/api/embed" and vectors_of({"data": [{"embedding": [1]}]}) == [[1]]
    assert shortened("a" * 10, 4) == "aa ... aa"


def test_embeddings(spark):
    got = with_embeddings(spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string"), "t", HashingEmbedder(8)).collect()
    assert sum(x * x for x in got[0].vector) == pytest.approx(1) and len(got[1].vector) == 8


def test_cached_generation(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "none"), (4, "b")], "k int, prompt string")
    key = generate.cache_key("s", "upper", "v", F.sha2(F.lit("b"), 256), 0.3)
    cache = spark.range(1).select(key.alias("key"), F.lit("held").alias("value"))
    out, new = generate.cached_answers(rows, "prompt", upper(), cache, "s", "v")
    assert {r.k: (r.answer, r.cache_hit) for r in out.collect()} == {1: ("A", False), 2: ("A", False), 3: (None, False), 4: ("held", True)}
    assert [r.value for r in new.collect()] == ["A"]


def test_sources_and_steps(spark):
    rows = spark.createDataFrame([(1, " text ", [("narration", "m"), ("x", " "), ("", "z"), ("late", "l")])], "chapter_id int, text string, memories array<struct<source_type:string,text:string>>")
    got = [tuple(r)[1:] for r in generate.evidence_sources(rows, 3).orderBy("pos").collect()]
    assert got == [(0, "chapter", "text"), (1, "narration", "m"), (3, "memory", "z")]
    q = spark.createDataFrame([("b", i, f"q{i}") for i in range(1, 7)], "book_id string, idx int, query_text string")
    assert [r.query_text for r in generate.step_queries(q, "per_step_shared", 3).orderBy("idx").collect()] == ["q1"] * 3 + ["q4"] * 3
    assert generate.step_queries(q, "off", 3).count() == 0


def test_reduction_ends(spark):
    items = spark.createDataFrame([("b", i, "x" * 40) for i in range(10)] + [("c", 0, "y" * 500), ("c", 1, "y" * 500)], "book_id string, idx long, text string")
    got = generate.reduced(items, 100, lambda d: d.withColumn("text", F.substring("text", 1, 30))).groupBy("book_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("s")).collect()
    assert {r.book_id: r.n for r in got} == {"b": 2, "c": 2}


def test_config(tmp_path):
    assert merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    assert dotenv("# x\nA='1 2'\nexport B=3\n") == {"A": "1 2", "B": "3"}
    (tmp_path / "c.yaml").write_text("narration: {step_size: 5}\n")
    c = load(str(tmp_path / "c.yaml"), {"narration": {"step_size": 2, "memory_top_k": 1}}, env={"SKEIN_DATA": "d"})
    assert (c.narration.step_size, c.narration.memory_top_k, c.data) == (5, 1, "d")
    for bad in ({"x": 1}, {"ingest": {"split": {"overlap": 2000}}}, {"narration": {"ratio_high": 1.5}}):
        with pytest.raises(ValueError):
            build(Config, bad)
    assert generate.route({"default": "d", "narration": "n"}, "refine") == "n"
    assert generate.model_identifier("p", "e", "m") == "p/e/m/max_tokens=provider_default/extra_body=-"


def test_command_line(spark, tmp_path):
    (tmp_path / "b.txt").write_text("第1章 始\n甲乙丙丁\n第2章 续\n戊己庚辛", encoding="utf-8")
    library = stored.library(spark, f"file://{tmp_path}/data")
    where = ["--data-dir", f"file://{tmp_path}/data", "--output-dir", f"file://{tmp_path}/out"]
    main([*where, "run", f"file://{tmp_path}/b.txt"])
    main([*where, "ingest", f"file://{tmp_path}/b.txt"])
    files = sorted(x.name for x in tmp_path.glob("out/*/*"))
    assert {"001_第1章_始.md", "002_第2章_续.md", "full_story.md"} <= set(files) and not any(x.startswith(".") for x in files)
    assert library.read("chapters").count() == 2
    assert {"story.md", "characters.md", "timeline.md", "book_summary.md", "world_state.json"} <= set(files)
    main([*where, "storytell", "--from-chapter", "2", "--to-chapter", "2", "--no-export"])
    assert library.read("narrations").count() == 2  # nothing is narrated twice
    (tmp_path / "b.txt").write_text("第1章 始\n甲乙丙丁\n第2章 续\n戊己庚辛\n第3章 新\n天地玄黄", encoding="utf-8")
    main([*where, "ingest", f"file://{tmp_path}/b.txt"])
    main([*where, "embed"])
    main([*where, "storytell", "--from-chapter", "3"])
    assert library.read("narrations").count() == 3
    kinds = {r.source_type: r.n for r in library.read("passages").groupBy("source_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"chunk": library.read("chunks").count(), "narration": 2}
    main([*where, "summarize"])
    assert library.read("summaries").where("summary_type = 'story'").count() == 2
    main([*where, "export", "--mode", "legacy"])


def test_streams(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(days=d), f"k{d % 2}", float(d), f"h{d % 3}", d % 2, d) for d in range(12)]
    schema = "ts timestamp, event_type string, value double, h string, book_id long, chapter_idx int"
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert drain(steps(read()), "steps", "complete").agg(F.sum("n")).first()[0] == 12
    assert drain(fresh(read(), "h", late="60 days"), "fresh", "append").count() == 3
    state = drain(folded_state(read().select("book_id", F.col("event_type").alias("fact_key"), "chapter_idx", F.col("value").cast("string").alias("value"))), "state", "update")
    last = {r.book_id: r for r in state.orderBy("n").collect()}
    assert (last[0].first_idx, last[0].last_idx, last[0].n, last[0].value) == (0, 10, 6, "10.0")
