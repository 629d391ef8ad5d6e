"""Communities against moves made one half after another in plain Python."""

import random

from pyspark.sql import functions as F

from glossweave.operators import graph


def by_hand(links, turns, sweeps):
    near = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    m2 = 2 * len(links)
    degree, place = {n: len(x) for n, x in near.items()}, {n: n for n in near}
    volume = lambda: {c: sum(degree[n] for n in near if place[n] == c) for c in set(place.values())}
    score = lambda: sum(place[a] == place[b] for a, b in links) / (m2 / 2) - sum(v * v for v in volume().values()) / (m2 * m2)
    best, top = dict(place), score()
    for sweep in range(sweeps):
        for half in (0, 1):
            total, moved = volume(), dict(place)
            for n in near:
                if turns[n][sweep] == half:
                    options = []
                    for c in {place[n], *(place[x] for x in near[n])}:
                        ties, own = sum(place[x] == c for x in near[n]), c == place[n]
                        gain = ties / m2 - degree[n] * (total[c] - own * degree[n]) / (m2 * m2)
                        options.append((-round(gain, 12), not own, c))
                    moved[n] = min(options)[2]
            place = moved
        if score() <= top:
            break
        best, top = dict(place), score()
    first = {c: min(n for n in best if best[n] == c) for c in best.values()}
    return {n: first[c] for n, c in best.items()}


def test_communities_equal_moves_by_hand(spark, monkeypatch):
    r = random.Random(4)
    links = sorted({tuple(sorted(f"w{g}_{r.randint(0, 11)}" for _ in "ab")) for g in range(4) for _ in range(40)})
    links = [x for x in links if x[0] != x[1]] + [(f"w{g}_0", f"w{g + 1}_1") for g in range(3)]
    tables, write = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label="step": (tables.setdefault(label, []).append(df.dtypes), write(df, label))[1])
    edges = spark.createDataFrame([*links, ("alone", "alone")], "src string, dst string")
    got = {x.node: x.community for x in graph.communities(edges, sweeps=4).collect()}
    nodes = spark.createDataFrame([(n,) for n in sorted({n for x in links for n in x})], "node string")
    turns = nodes.select("node", F.array(*[F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) for k in range(4)]).alias("t"))
    assert got == by_hand(links, {x.node: x.t for x in turns.collect()}, 4) and 1 < len(set(got.values())) < 20
    # Numbers go to and fro, not names.
    assert dict(tables["links"][0])["src"] == "bigint" and all(dict(t)["community"] == "bigint" for t in tables["communities"])
    assert graph.communities(edges.filter("src = 'alone'")).count() == 0
