import heapq
import itertools
import random

import pytest

from glossweave.operators import clusters, graph


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def random_edges(n=40, m=55, seed=4):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(f"n{a:02d}", f"n{b:02d}", round(rng.uniform(0.3, 1.0), 3)) for a, b in sorted(pairs)]


def brute_components(rows, nodes=None):
    label = {x: x for r in rows for x in r[:2]} | {x: x for x in nodes or []}
    for _ in label:
        for a, b, _w in rows:
            low = min(label[a], label[b])
            label = {k: low if v in (label[a], label[b]) else v for k, v in label.items()}
    return label


def test_known_graph(spark):
    df = edges_of(spark, [("a", "b", 0.9), ("b", "c", 0.85), ("d", "e", 0.95)])
    assert {tuple(r) for r in graph.components(graph.above(df, 0.8)).collect()} == {
        ("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    row = graph.stats(graph.above(df.filter("src < 'd'"), 0.5)).first()
    assert (row.nodes, row.edges, row.components) == (3, 2, 1)
    assert row.avg_degree == pytest.approx(4 / 3) and row.density == pytest.approx(2 / 3)


def test_components_of_random_graph_and_long_chain(spark):
    rows = random_edges()
    assert {tuple(r) for r in graph.components(edges_of(spark, rows)).collect()} == set(brute_components(rows).items())
    rng = random.Random(7)
    names = [f"x{i:03d}" for i in rng.sample(range(200), 200)]
    chain = [(a, b, 1.0) for a, b in itertools.pairwise(names)]
    assert {r.component for r in graph.components(edges_of(spark, chain)).collect()} == {"x000"}


def test_self_loop_is_its_own_component(spark):
    df = edges_of(spark, [("a", "a", 1.0), ("b", "c", 1.0)])
    assert {tuple(r) for r in graph.components(df).collect()} == {("a", "a"), ("b", "b"), ("c", "b")}


def test_threshold_clusters_keep_lone_nodes(spark):
    rows = [("0", "1", 0.9), ("1", "2", 0.85), ("3", "4", 0.95), ("4", "5", 0.1)]
    got = dict(tuple(r) for r in graph.threshold_clusters(edges_of(spark, rows), 0.8).collect())
    assert got == {"0": "0", "1": "0", "2": "0", "3": "3", "4": "3", "5": "5"}


def test_pagerank(spark):
    rows = random_edges()
    got = dict(tuple(r) for r in graph.pagerank(edges_of(spark, rows), 0.85, 12).collect())
    near = {}
    for a, b, _ in rows:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    rank = {x: 1 / len(near) for x in near}
    for _ in range(12):
        rank = {x: 0.15 / len(near) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in near}
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1.0)


def test_shortest_paths(spark):
    rows = random_edges()
    df = edges_of(spark, rows)
    near = {}
    for a, b, w in rows:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    start = rows[0][0]
    best, queue = {}, [(0.0, start)]
    while queue:
        cost, node = heapq.heappop(queue)
        if node not in best:
            best[node] = cost
            for other, w in near[node]:
                heapq.heappush(queue, (cost + w, other))
    source = spark.createDataFrame([(start,)], "node string")
    assert dict(tuple(r) for r in graph.shortest_paths(df, source).collect()) == pytest.approx(best)


def test_modularity_and_communities(spark):
    clique = lambda names: [(a, b, 1.0) for a, b in itertools.combinations(names, 2)]
    df = edges_of(spark, clique("abcd") + clique("wxyz") + [("d", "w", 1.0)])
    found = graph.communities(df)
    assert {tuple(r) for r in found.collect()} == {(x, "a") for x in "abcd"} | {(x, "w") for x in "wxyz"}
    assert graph.modularity(df, found).first()[0] == pytest.approx(2 * (6 / 13 - (13 / 26) ** 2))
    halved = graph.modularity(df, found, 0.5).first()[0]
    assert halved == pytest.approx(2 * (6 / 13 - 0.5 * (13 / 26) ** 2))


def test_sparse_matrix(spark):
    df = edges_of(spark, [("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.7)])
    assert tuple(graph.sparse_facts(df, 0.5).first()) == (3, 9, 0.0)
    weak = graph.sparse_facts(df, 0.85).first()
    assert (weak.n, weak.nnz) == (3, 5)
    cells = graph.sparse_entries(df, 0.5)
    vector = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "node string, x double")
    assert {r.node: round(r.y, 6) for r in graph.matvec(cells, vector).collect()} == {"a": 2.8, "b": 2.9, "c": 2.3}
    rows = {r.i: r["values"] for r in graph.dense_rows(graph.sparse_entries(df, 0.75), ["a", "c"]).collect()}
    assert rows == {"a": [1.0, 0.0], "c": [0.0, 1.0]}
    chosen = spark.createDataFrame([("a",), ("b",)], "node string")
    assert graph.submatrix(cells, chosen).count() == 4


def test_nearest(spark):
    df = edges_of(spark, [("a", "b", 0.9), ("a", "c", 0.7), ("a", "d", 0.5), ("a", "e", 0.7)])
    got = [(r.dst, r.weight) for r in graph.nearest(df, 2, 0.4).filter("src = 'a'").orderBy("rank").collect()]
    assert got == [("b", 0.9), ("e", 0.7)]
    assert {r.neighbour for r in graph.neighbours(df, "a", 0.7).collect()} == {"b", "c", "e"}


def test_export(spark, tmp_path):
    df = edges_of(spark, [("a", "b", 0.9)])
    graph.export(df, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/edges").first().asDict() == {"source": "a", "target": "b", "weight": 0.9}


def test_silhouette_and_variance(spark):
    rng = random.Random(9)
    points = list(range(12))
    pairs = [(a, b, rng.random()) for a, b in itertools.combinations(points, 2) if rng.random() < 0.7]
    cluster = {p: p % 4 if p < 10 else p for p in points}
    df = spark.createDataFrame(pairs, "a int, b int, similarity double")
    members = spark.createDataFrame(list(cluster.items()), "id int, cluster int")
    sim = {frozenset(p[:2]): p[2] for p in pairs}
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    total = 0.0
    for p in points:
        gaps = lambda c: [1 - sim[frozenset((p, q))] for q in points if q != p and cluster[q] == c and frozenset((p, q)) in sim]
        if list(cluster.values()).count(cluster[p]) == 1:
            continue
        a = mean(gaps(cluster[p])) or 0.0
        b = min((mean(gaps(c)) for c in set(cluster.values()) if c != cluster[p] and gaps(c)), default=float("inf"))
        total += 1 - a / b if a < b else b / a - 1 if a > b else 0.0
    assert clusters.silhouette(df, members).first()[0] == pytest.approx(total / len(points))
    squares, n = 0.0, 0
    for c in set(cluster.values()):
        inside = [s for (a, b, s) in pairs if cluster[a] == cluster[b] == c]
        squares, n = squares + sum((s - mean(inside)) ** 2 for s in inside), n + len(inside)
    assert clusters.within_variance(df, members).first()[0] == pytest.approx(squares / n)


def test_set_confidence_and_links(spark):
    edges = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.6), (3, 9, 0.9)], "entry_a int, entry_b int, combined_score double")
    members = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s"), (9, "t"), (5, "u"), (6, "u")], "id int, set_id string")
    sets = clusters.set_confidence(edges, members)
    assert {r.set_id: (r.size, round(r.confidence, 6)) for r in sets.collect()} == {"s": (3, 0.7), "t": (1, 1.0), "u": (2, 0.0)}
    assert {(r.source, r.target) for r in clusters.set_links(members, sets).collect()} == {(1, 2), (1, 3), (5, 6)}


def test_components_shrink_with_each_round(spark, monkeypatch):
    """A path in shuffled names: the work of all rounds stays a small multiple of its edges."""
    seen, write = [], graph.materialize_counting

    def counting(df, condition, label):
        out, n = write(df, condition, label)
        seen.append((label, n))
        return out, n

    monkeypatch.setattr(graph, "materialize_counting", counting)
    nodes = [f"{i * 7919 % 400:03d}" for i in range(400)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in zip(nodes, nodes[1:])] + [("x", "x", 1.0), ("y", "z", 1.0)], "src string, dst string, weight double")
    found = {(r.node, r.component) for r in graph.components(edges).collect()}
    assert found == {(n, "000") for n in nodes} | {("x", "x"), ("y", "y"), ("z", "y")}
    links = [n for label, n in seen if label == "links"]
    assert links[0] == 400 and links[-1] == 0 and sum(links) < 4 * links[0]
    assert all(a > b for a, b in zip(links, links[1:]))


def test_components_need_few_rounds(spark, monkeypatch):
    """The shrinking is fast: a path of 400 edges is gone after few rounds, lone nodes need none."""
    rounds, write = [], graph.materialize_counting

    def counting(df, condition, label):
        rounds.append(label)
        return write(df, condition, label)

    monkeypatch.setattr(graph, "materialize_counting", counting)
    nodes = [f"{i * 7919 % 400:03d}" for i in range(400)]
    rows = [(a, b, 1.0) for a, b in zip(nodes, nodes[1:])] + [("x", "y", 0.1)]
    found = {tuple(r) for r in graph.threshold_clusters(edges_of(spark, rows), 0.5).collect()}
    assert found == {(n, "000") for n in nodes} | {("x", "x"), ("y", "y")}
    assert len(rounds) <= 6
