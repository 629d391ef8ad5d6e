
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.functions import vectors
from glossweave.operators import concepts, trees
from glossweave.operators.entries import search_vectors
from glossweave.plans import layout


def blobs(spark, n=60, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(3, dims)) * 4
    rows = [
        (i, (middle[i % 3] + rng.normal(size=dims) * 0.3).tolist(), f"c{i % 3}", "en de".split()[i % 2], f"word{i % 3} number{i}", f"w{i}")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, embedding array<float>, concept_id string, language string, definition string, headword string")


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    out = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.unit(F.col("a"))).collect()
    assert tuple(out[0]) == (24.0, 5.0, 0.96, [0.6, 0.8]) and tuple(out[1]) == (0.0, 0.0, None, [0.0, 0.0])


def test_search(spark):
    df = blobs(spark)
    target = df.first().embedding
    got = [r.id for r in search_vectors(df, target, 5, 0.5).collect()]
    v = {r.id: np.array(r.embedding) for r in df.collect()}
    cos = {i: x @ v[0] / np.linalg.norm(x) / np.linalg.norm(v[0]) for i, x in v.items()}
    assert got == sorted(cos, key=lambda i: -cos[i])[:5]


def test_profile_and_assignment(spark):
    df = blobs(spark)
    found = concepts.profile(df)
    mean = np.mean([r.embedding for r in df.filter("concept_id = 'c1'").collect()], axis=0)
    row = found.filter("concept_id = 'c1'").first()
    assert row.centroid == pytest.approx(mean.tolist()) and row["size"] == 20 and row.languages == ["de", "en"]
    assert row.sample_definitions[0] == "word1 number1" and len(row.sample_definitions) == 5 and row.label == "WORD1_NUMBER1"
    bare = df.withColumnRenamed("concept_id", "truth")
    whole = {r.id: (r.concept_id, round(r.confidence, 9)) for r in concepts.assign(bare, found).collect()}
    pieces = {r.id: (r.concept_id, round(r.confidence, 9)) for r in concepts.assign(bare, found, budget=150).collect()}
    assert whole == pieces
    assert all(whole[r.id][0] == r.truth for r in bare.collect())


def test_concept_discovery(spark):
    df = blobs(spark, 90)
    truth = {r.id: r.concept_id for r in df.collect()}
    for found in (concepts.kmeans_concepts(df, 3, min_size=10), concepts.density_concepts(df, 2, min_samples=4, min_size=10)):
        got = {r.id: r.concept_id for r in found.collect()}
        assert len(set(got.values())) == 3 and len(got) > 80
        assert len({(truth[i], c) for i, c in got.items()}) == 3
        assert set(got.values()) == {"concept_0000", "concept_0001", "concept_0002"}


def test_embedding_reuses_equal_texts(spark):
    df = spark.createDataFrame([(1, "red fire", None), (2, "red fire", None), (3, "cold", [1.0]), (4, None, None)], "id int, definition string, embedding array<float>")
    for rows in (1, 1000):
        out = {r.id: r.embedding for r in concepts.embed_missing(df, spread_rows=rows).collect()}
        assert out[1] == out[2] and sum(x * x for x in out[1]) == pytest.approx(1.0) and out[3] == [1.0] and out[4] is None


def test_user_model(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    load = lambda: lambda texts: np.array([[len(t), 0.0] for t in texts])
    assert [r.embedding for r in concepts.model_vectors(df, "t", load).collect()] == [[1.0, 0.0], [1.0, 0.0]]


def test_language_similarity_is_the_mean_over_all_pairs(spark):
    df = blobs(spark)
    rows = df.collect()
    cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    want = np.mean([cos(a.embedding, b.embedding) for a in rows for b in rows if a.language == "de" and b.language == "en"])
    got = concepts.language_similarity(df).first()
    assert (got.a, got.b) == ("de", "en") and got.similarity == pytest.approx(want)


def matrix(spark, labels, d, grp="g"):
    n = range(len(labels))
    return spark.createDataFrame([(grp, labels[i], labels[j], float(d[i][j])) for i in n for j in n], "grp string, a string, b string, d double")


FOUR = [[0, .2, .4, .6], [.2, 0, .3, .5], [.4, .3, 0, .4], [.6, .5, .4, 0]]


def test_distances(spark):
    df = spark.createDataFrame([("g", "w1", "w2", .8), ("g", "w1", "w3", .3)], "grp string, a string, b string, similarity double")
    got = {(r.a, r.b): round(r.d, 6) for r in trees.distances(df).collect()}
    assert got == {("w1", "w1"): 0, ("w2", "w2"): 0, ("w3", "w3"): 0, ("w1", "w2"): .2, ("w2", "w1"): .2,
                   ("w1", "w3"): .7, ("w3", "w1"): .7, ("w2", "w3"): 0, ("w3", "w2"): 0}


def test_dendrogram_of_words(spark):
    labels = ["agua_es", "eau_fr", "wasser_de", "water_en"]
    d = [[0, .1, .6, .7], [.1, 0, .65, .7], [.6, .65, 0, .1], [.7, .7, .1, 0]]
    for method in ("ward.D2", "average", "complete", "single"):
        steps = trees.dendrograms(matrix(spark, labels, d), method).orderBy("step").collect()
        assert {frozenset(s.left + s.right) for s in steps[:2]} == {frozenset(labels[:2]), frozenset(labels[2:])}
        assert [round(s.height, 6) for s in steps[:2]] == [.1, .1]
    heights = {m: trees.dendrograms(matrix(spark, labels, d), m).orderBy("step").collect()[-1].height for m in ("single", "complete", "average")}
    assert heights == pytest.approx({"single": .6, "complete": .7, "average": (.6 + .7 + .65 + .7) / 4})


def additive():
    """Distances on a known tree ((a,b),c,(d,e)) with unequal branch lengths."""
    edges = {"a": .1, "b": .2, "c": .3, "d": .15, "e": .25}
    inner = {"ab": .2, "de": .35}
    side = {"a": "ab", "b": "ab", "d": "de", "e": "de"}
    names = sorted(edges)
    d = [[0.0 if x == y else edges[x] + edges[y] + (0 if side.get(x) and side.get(x) == side.get(y) else inner.get(side.get(x), 0) + inner.get(side.get(y), 0))
          for y in names] for x in names]
    return names, d


def test_neighbour_joining_recovers_an_additive_tree(spark):
    names, d = additive()
    m = matrix(spark, names, d)
    found = trees.infer_trees(m, "nj")
    assert {round(r.on_tree - r.d, 9) for r in trees.tree_distances(found, m).collect()} == {0.0}
    fit = trees.tree_fit(found, m).first()
    assert fit.correlation == pytest.approx(1.0) and fit.interpretation == "Excellent tree fit"
    taxa = m.select("grp", F.col("a").alias("taxon")).distinct()
    assert {r.split for r in trees.splits(found, taxa).collect()} == {"c,d,e", "d,e"}
    same = trees.compare_trees(found, trees.infer_trees(m, "ml"), taxa).first()
    assert (same.robinson_foulds, same.max_possible_rf, same.trees_identical) == (0, 4, True)
    other = spark.createDataFrame([("g", ["a", "c"], 1.0), ("g", ["d", "e"], 1.0)], found.schema)
    assert tuple(trees.compare_trees(found, other, taxa).first()) == ("g", 2, 0.5, 4, False)


def test_upgma_on_four_languages(spark):
    m = matrix(spark, ["deu", "eng", "fra", "spa"], FOUR)
    steps = trees.dendrograms(m, "average").orderBy("step").collect()
    assert steps[0].left + steps[0].right == ["deu", "eng"]
    fit = trees.tree_fit(trees.infer_trees(m, "upgma"), m).first()
    assert fit.correlation > 0.8


def test_bootstrap(spark):
    names, d = additive()
    out = trees.bootstrap_support(matrix(spark, names, d), 60, "nj").collect()
    assert all(r.support == 1.0 and r.replicates > 0 for r in out)


def test_too_many_taxa_are_refused(spark):
    m = matrix(spark, list("abcd"), FOUR)
    with pytest.raises(ValueError, match="more than 3 taxa"):
        trees.check_taxa(m, 3)


def test_layouts(spark):
    df = blobs(spark)
    points, explained = layout.language_space(df.unionByName(df.limit(1).withColumn("embedding", F.lit(None).cast("array<float>"))), 3)
    assert points.count() == 60 and 0.9 < explained <= 1.0 + 1e-9
    mapped, _ = layout.concept_map(concepts.profile(df), df, 2)
    assert {r.kind: r["count"] for r in mapped.groupBy("kind").count().collect()} == {"centroid": 3, "member": 60}
    edges = spark.createDataFrame([("w0", "w1", .9), ("w0", "w2", .1)], "src string, dst string, weight double")
    nodes, links = layout.similarity_network(df, edges)
    assert nodes.count() == 60 and links.count() == 1


def test_assign_gives_the_same_for_every_budget_on_tied_centroids(spark):
    rows = [(f"c{k}", [float(k + 1), float(k + 1) * 3.0]) for k in range(12)]
    concepts_df = spark.createDataFrame(rows, "concept_id string, centroid array<double>")
    entries_df = spark.createDataFrame([(1, [0.1, 0.3]), (2, [7.0, 21.0])], "id int, embedding array<double>")
    from glossweave.operators.concepts import assign

    one, many = (sorted(tuple(r)[0:3:2] for r in assign(entries_df, concepts_df, b).select("id", "embedding", "concept_id").collect()) for b in (64 << 20, 300))
    assert one == many == [(1, "c0"), (2, "c0")]
