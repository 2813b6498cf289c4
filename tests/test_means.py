"""Means of vectors against SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from lexfold.plans.registry import ORACLE, QUERIES


def test_means_are_rounded_as_sql_does(spark, tmp_path):
    x = [1.000005, 0.000015, -0.000015, 2.675005, 1.005005, 0.123455, -0.000001, 8.000025]
    pq.write_table(pa.table({"vec_id": pa.array(range(0, 3 * len(x), 3), pa.int64()), "embedding": pa.array([[v, -v, v * 3] for v in x], pa.list_(pa.float64())), "label": pa.array([0] * len(x), pa.int32())}), f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted((d, list(map(repr, v))) for d, v in con.sql(ORACLE["a15_mean_vectors"]).fetchall())
    assert sorted((r[0], list(map(repr, r[1]))) for r in QUERIES["a15_mean_vectors"](spark, str(tmp_path)).collect()) == want
