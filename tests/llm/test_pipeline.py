"""The pipeline's stages on small tables, and its registration."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from assayline.llm import common


def test_queries_are_registered():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in entry_point.queries()


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [("start", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], folder).persist()))
    return out


def test_stages_return_documents(stages):
    columns = stages[0][1].columns
    for (_, before), (name, after) in zip(stages, stages[1:]):
        if name != "bpe":
            assert after.columns == columns and after.schema == stages[0][1].schema
        assert after.select("doc_id").distinct().count() == after.count()
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0


def test_stages_take_effect(stages, spark, folder):
    by = dict(stages)
    assert by["line_dedup"].count() == by["toxicity"].count()
    every = by["line_dedup"].select(F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.btrim("line", F.lit(" \t\r"))) >= 10)
    assert every.count() == every.distinct().count()
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    from assayline.llm import decontaminate, simhash

    assert simhash.near_duplicates(by["simhash"]).where("doc_id <> component_id").count() == 0
    assert decontaminate.contained(by["decontamination"], benchmark).where(F.size("starts") > 0).count() == 0
    assert by["bpe"].count() == by["decontamination"].count()


def test_run_gives_the_last_stage(spark, folder, stages):
    assert corpus_pipeline.run(spark, folder).count() == stages[-1][1].count()


def test_stages_on_odd_rows(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, starts string"
    rows = [(1, None, "en", "s", None, 0.1, "x"), (2, "", None, None, 0, None, None), (None, "no id here", "en", "s", 10, 0.2, "y"),
            (3, "the same text of one line", "en", "s", 25, 0.3, "z"), (3, "the same text of one line", "en", "s", 25, 0.3, "z")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            assert name == "bpe" or docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert docs.count() <= len(data)


def test_workers_keep_the_tables_of_one_step():
    """What a worker keeps for its next tasks is gone when another step begins."""
    made = []

    def make(name):
        made.append(name)
        return name

    for name in ("a", "a", "b", "a"):
        assert common._begun(lambda name=name: common.kept(make, name)) == name
    assert made == ["a", "b", "a"]
    common._begun(lambda: None)
    assert not common._kept
