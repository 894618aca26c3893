import random

from quillgraph.operators import vectors


def test_dense_blocks(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<double>")
    found = lambda **x: sorted(tuple(r) for r in vectors.dense_top_k(rows, rows.where("vec_id % 2 = 0"), 3, **x).select("query_id", "key", "rank").collect())
    whole = found()
    assert len(whole) == 90 and found(most=7) == whole and found(most=1_000) == whole
