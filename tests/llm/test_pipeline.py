import corpus_pipeline
import pytest
from lexfold.llm import jaccard_join
from pyspark.sql import functions as F

from tests.llm import data
from tests.llm.test_dedup_ops import jaccard_brute, line_brute


def _labels(spark, tmp_path, n):
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


def test_stages_keep_columns_and_drop_copies(spark, tmp_path):
    texts = [t for t in data.near_copies(groups=8, copies=3, n=80) if len(t.split()) > 30]
    docs = data.frame(spark, data.rows(texts)).withColumn("extra", F.lit("kept"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    _labels(spark, tmp_path, len(texts))
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).toPandas(), docs.schema)
        assert now.columns == docs.columns, name
        counts.append(now.count())
    assert len(texts) >= counts[0] >= counts[1] > counts[2] > 0
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() >= now.select("doc_id").distinct().count()


@pytest.mark.parametrize(("stage", "name"), [(s, n) for n, s in corpus_pipeline.STAGES[:-1]])
def test_stages_take_odd_rows_and_names(spark, tmp_path, stage, name):
    """Nulls in any column, empty and very long texts, repeated rows, dotted and clashing names; then no rows at all."""
    _labels(spark, tmp_path, 10)
    clash = {"a.b": F.lit(1), "quality": F.lit("q"), "mixing": F.lit("m"), "line_dedup": F.lit("l"), "label": F.lit(2), "h": F.lit(3), "gone_d": F.lit(4)}
    df = data.odd(spark).unionByName(data.frame(spark, [(50 + i, " ".join(f"word{i}x{j}" for j in range(40)), "en", "s", 0) for i in range(3)])).withColumns(clash)
    path = str(tmp_path / "odd.parquet")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    out = stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = out.collect()
    assert {r["quality"] for r in rows} <= {"q"} and rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in df.collect()}
    none = stage(spark, df.limit(0), str(tmp_path))
    assert none.columns == df.columns and none.count() == 0


def test_last_stage_takes_odd_rows(spark, tmp_path):
    df = data.odd(spark).withColumn("length", F.lit("clash"))
    stage = corpus_pipeline.STAGES[-1][1]
    out = stage(spark, df, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in out) == df.count()
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_one_row_of_each_group_stays(spark):
    copy = "one text of at least five words and some more"
    other = "another text of more than five words that is alone"
    rows = [(0, copy, "en", "s", 1), (0, copy, "en", "s", 1), (1, copy, "en", "s", 2), (None, copy, "en", "s", 3), (None, other, "en", "s", 4), (None, other, "en", "s", 4), (None, None, "en", "s", 5), (None, "", "en", "s", 6), (7, None, "en", "s", 7)]
    out = jaccard_join.keep_one_of_each_group(spark, data.frame(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(0, copy), (None, other), (None, None), (None, ""), (7, None)], key=str)


def test_dedup_stages_match_brute_force(spark, tmp_path):
    texts = [t.replace(" v7", "\nv7").replace(" v3", "\nv3") for t in data.near_copies(seed=5, groups=6, copies=4, n=60)]
    docs = data.frame(spark, data.rows(texts))
    lines = corpus_pipeline.STAGES[1][1](spark, docs, "")
    want = [(i, t) for i, (n, gone, t) in enumerate(line_brute(texts)) if not gone or gone < n]
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == want
    kept = corpus_pipeline.STAGES[2][1](spark, docs, "")
    groups = jaccard_brute(list(range(len(texts))), texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, n, c in groups if i == c)
