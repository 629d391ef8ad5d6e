"""Density clusters against all pairs, on planted clusters, a hot cell and noise."""

import numpy as np
import pytest

from glossweave.operators.density import density_clusters


def by_force(points, radius, min_samples, min_size):
    ids = sorted(points)
    v = np.array([points[i] for i in ids])
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2))
    close = d <= radius + 1e-12
    core = close.sum(1) >= min_samples
    label = {}
    for s in range(len(ids)):
        if core[s] and s not in label:
            label[s], todo = s, [s]
            while todo:
                for t in np.flatnonzero(close[todo.pop()] & core).tolist():
                    if t not in label:
                        label[t] = s
                        todo.append(t)
    for s in range(len(ids)):
        if not core[s]:
            best = min(((d[s, t], ids[t], t) for t in np.flatnonzero(close[s] & core).tolist()), default=None)
            if best:
                label[s] = label[best[2]]
    sizes = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    return {(ids[s], ids[c], bool(core[s])) for s, c in label.items() if sizes[c] >= min_size}


@pytest.mark.parametrize("dims, chunk, sample", [(2, 2048, 64), (3, 40, 2)])
def test_density_clusters(spark, dims, chunk, sample):
    r = np.random.default_rng(dims)
    blobs = [r.normal(size=(120, dims)) * 0.4 + m for m in ([0.0] * dims, [3.0] * dims, [3.0, 6.0, 0.0][:dims])]
    bridge = np.linspace(blobs[0].mean(0), blobs[1].mean(0), 60)
    noise = r.uniform(-4, 9, size=(80, dims))
    hot = np.tile([[7.5] * dims], (150, 1))
    points = np.concatenate([*blobs, bridge, noise, hot])
    order = r.permutation(len(points))
    rows = {int(order[i]): p.tolist() for i, p in enumerate(points)}
    df = spark.createDataFrame([*rows.items(), (9000, None), (9001, [float("nan")] * dims), (9002, [None] * dims)], "id long, reduced array<double>")
    for radius, least in ((0.45, 30), (0.8, 5)):
        want = by_force(rows, radius, 10, least)
        got = density_clusters(df, radius, 10, least, chunk=chunk, sample=sample).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want) and len({c for _, c, _ in want}) >= 2
    assert density_clusters(df.limit(0), 1.0).count() == 0
