"""Top products when blocks, buckets and rows of the grid are many and small."""

import numpy as np

from glossweave.llm import topk


def test_grid_of_small_blocks_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=d) * r.choice([0.2, 1, 5])).tolist()) for i, d in enumerate([6] * 500 + [3] * 60)]
    # Copies of one vector fill whole buckets; ids that stand twice are vectors of their own.
    rows += [(1000 + i % 20, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(60)]
    rows += [(5, None), (10, [1.0, float("nan")]), (None, [1.0] * 6), (15, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_products(vectors, k=4, every=5, bucket=16, block=8, sample=16, held=2).collect()

    whole = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and np.isfinite(v).all()]
    want = set()
    for q in {i for i, _ in whole if i % 5 == 0}:
        mine = min((v.tolist() for i, v in whole if i == q))
        scores = sorted((-int(np.dot(mine, v)), i) for i, v in whole if i != q and len(v) == len(mine))[:4]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
