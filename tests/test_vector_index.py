import numpy as np

from glossweave.operators.vector_index import build_index, search_index


def test_index_gives_the_exact_nearest_from_few_cells(spark, tmp_path):
    r = np.random.default_rng(1)
    middles = r.normal(size=(12, 8)) * 4
    vectors = [(middles[i % 12] + r.normal(size=8) * 0.2).tolist() for i in range(600)] + [[1.0] * 8] * 3
    df = spark.createDataFrame([*enumerate(vectors), (700, [0.0] * 8), (701, None)], "id long, embedding array<double>")
    build_index(df, str(tmp_path / "i"), cells=24)
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    for target, k, least in ((vectors[5], 10, -1.0), (vectors[6], 45, 0.2), ([1.0] * 8, 2, 0.9), ((-middles[0]).tolist(), 5, -1.0), (vectors[7], 700, 0.0)):
        close = unit @ (np.array(target) / np.linalg.norm(target))
        want = sorted(((-round(float(c), 10), i) for i, c in enumerate(close) if c >= least))[:k]
        found, cells = search_index(spark, str(tmp_path / "i"), target, k, least)
        assert [(-round(x.similarity, 10), x.id) for x in found.collect()] == want
        assert cells["cells_read"] <= cells["cells"] <= 24
    _, cells = search_index(spark, str(tmp_path / "i"), vectors[5], 10)
    assert cells["cells_read"] < cells["cells"] / 2
