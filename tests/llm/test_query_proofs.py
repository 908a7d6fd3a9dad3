"""Registered queries against their SQL on tables in which they have something to find."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import registry

SF = "/root/testdata/sf0.001"


def rows_of(con, sql, columns):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())


def test_near_vectors_of_scaled_and_jittered_copies_match_the_sql(spark, tmp_path):
    # Every vector of the given table, and copies of it: scaled, jittered about the threshold, and in chains.
    own = spark.read.parquet(f"{SF}/embeddings.parquet").where(F.size("embedding") == 64).toPandas()
    rng, rows = np.random.default_rng(1), []
    for i, r in own.iterrows():
        v = np.array(r["embedding"], dtype=np.float64)
        rows.append((int(r["vec_id"]), v, r["label"]))
        for k in range(int(rng.integers(0, 4))):
            # Cosines to the last copy from 0.96 to 1.
            off = rng.standard_normal(64)
            off -= off @ v / (v @ v) * v
            v = rng.uniform(0.2, 3) * (v / np.linalg.norm(v) + rng.uniform(0, 0.28) * off / np.linalg.norm(off))
            rows.append((1_000_000 + 10 * int(r["vec_id"]) + k, v, r["label"]))
    frame = spark.createDataFrame([(i, [float(np.float32(x)) for x in v], None if label is None or label != label else int(label)) for i, v, label in rows], "vec_id long, embedding array<float>, label int")
    frame.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    columns = ("vec_id", "n_links", "component_id", "kept")
    got = sorted(tuple(r[c] for c in columns) for r in registry.op7_embedding_dedup(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = rows_of(con, registry.oracle_sql()["op7_embedding_dedup"], columns)
    assert got == want
    assert sum(n > 0 for _, n, *_ in want) > 50 and max(n for _, n, *_ in want) > 1


def test_clusters_and_runs_match_the_sql_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = [(i % 60, rng.normal(size=64).round(1).tolist()) for i in range(90)] + [(200, None), (201, [1.0] * 63), (202, [float("nan")] * 64), (203, [None] * 64), (204, [-0.0] * 64), (205, [1e-9] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = [None, "", " \n\t", "a " * 50, "a b " * 9 + "a", "x\ty\nx y x y x y x y", "Ä b c d " * 6, " ".join(str(i % 17) for i in range(400))] * 30
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op11_centroids", "op12_periodic_runs"):
        df = registry.queries()[name](spark, str(tmp_path))
        got = sorted((tuple(r) for r in df.collect()), key=repr)
        cursor = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert got == sorted((tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()), key=repr)
        assert len(got) == {"op11_centroids": 92, "op12_periodic_runs": 240}[name]
