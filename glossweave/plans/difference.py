"""Why do two languages use different words for one concept?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glossweave.functions import phonetic, scores
from glossweave.functions.tree import add_tree_distance
from glossweave.functions.vectors import dot, unit
from glossweave.operators.clusters import greedy_leaders
from glossweave.operators.pairs import layered_scores, scored_pairs
from glossweave.operators.skew import MAX_TAXA, require_small_groups
from glossweave.operators.windows import first_n
from glossweave.session import materialize

# Fixed value: score from which two forms count as cognates.
COGNATE_CUT = 0.6


def comparable(entries: DataFrame) -> DataFrame:
    """Entries with what every comparison needs: sound count and unit vector."""
    return entries.withColumns({"size": F.size(phonetic.graphemes(F.col("ipa"))), "unit": unit(F.col("embedding"))})


def cognate_score(pairs: DataFrame, cut: float = 0.0) -> DataFrame:
    """Layered score with cognate weights for rows with comparable structs a and b.

    Pairs whose sound alone rules out a score of ``cut`` are left out: meaning
    and origin add at most their weights.
    """
    meaning_share, sound_share, origin_share = scores.WEIGHTS["cognate"]
    sound = phonetic.similarity(F.col("a.ipa"), F.col("b.ipa"), F.col("a.size"), F.col("b.size"))
    least = (cut - meaning_share - origin_share) / sound_share - 1e-9
    kept = pairs.withColumn("phonetic", sound).filter(F.col("phonetic") >= least)
    return layered_scores(kept, "cognate", semantic=dot(F.col("a.unit"), F.col("b.unit")))


def cognate_clusters(entries: DataFrame, threshold: float = COGNATE_CUT) -> DataFrame:
    """Star clusters per concept: (concept_id, id, leader).

    Only pairs that can be cognates are formed, by their sounds; leaders are
    found on these pairs, so no entry meets the leaders of its concept.
    """
    kept = entries.filter(F.col("concept_id").isNotNull())
    close = scored_pairs(kept, "cognate", threshold).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return kept.select("concept_id", "id").join(greedy_leaders(kept, close), "id").select("concept_id", "id", "leader")


def lexical_differences(entries: DataFrame, threshold: float = COGNATE_CUT) -> DataFrame:
    """One report row per concept and pair of languages that both name it.

    The first entry of a language stands for it, so a concept gives at most
    one row per pair of languages however many entries it has; all entries
    take part in the cognate clusters behind the report.
    """
    kept = entries.filter(F.col("concept_id").isNotNull() & F.col("ipa").isNotNull())
    # The clusters and three joins below all start from these rows.
    kept = materialize(
        comparable(kept).select("concept_id", "id", "headword", "ipa", "language", "embedding", "size", "unit"), "entries"
    )
    clusters = cognate_clusters(kept, threshold)
    placed = kept.join(clusters.select("id", "leader"), "id")
    first = first_n(
        kept.select("concept_id", "language", "id", "headword", "ipa", "size", "unit"), ["concept_id", "language"], ["id"], 1
    ).drop("rank")
    first = require_small_groups(materialize(first, "firsts"), ["concept_id"], MAX_TAXA, "languages")

    flagged = placed.join(first.select("id", F.lit(True).alias("_primary")), "id", "left")
    per = flagged.groupBy("concept_id", "leader", "language").agg(
        F.min("id").alias("any_id"), F.min(F.when(F.col("_primary").isNull(), F.col("id"))).alias("later_id"),
        F.max_by("headword", "id").alias("headword"),
    )
    forms = first.join(clusters.select("id", "leader"), "id")
    relatives = forms.select("id", "concept_id", "leader", F.col("language").alias("own")).join(
        per, ["concept_id", "leader"]
    )
    seen = F.when(F.col("language") == F.col("own"), F.col("later_id")).otherwise(F.col("any_id"))
    # One element per language of the cluster.
    listed = relatives.withColumn("seen", seen).filter("seen is not null").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("seen", "language", "headword"))).alias("cognates")
    )
    forms = forms.join(listed, "id", "left")
    none = F.array().cast(dict(forms.dtypes)["cognates"])
    forms = forms.withColumn("cognates", F.coalesce("cognates", none))

    side = lambda s: forms.select("concept_id", F.struct("id", "language", "headword", "ipa", "size", "unit", "leader", "cognates").alias(s))
    pairs = side("a").join(side("b"), "concept_id").filter(F.col("a.language") < F.col("b.language"))
    scored = cognate_score(pairs, cut=-1.0).drop("tree_distance")
    told = add_tree_distance(scored, "language_a", "language_b", keep=True)
    as_map = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["language"], x["headword"])))
    cluster = lambda s: F.concat(F.lit("cluster_"), F.col(f"{s}.leader").cast("string"))
    return told.select(
        "concept_id", "language_a", "language_b",
        F.col("a.headword").alias("form_a"), F.col("b.headword").alias("form_b"),
        cluster("a").alias("cluster_a"), cluster("b").alias("cluster_b"),
        as_map(F.col("a.cognates")).alias("cognates_a"), as_map(F.col("b.cognates")).alias("cognates_b"),
        "tree_distance", "phonetic", "semantic", "combined", explanation().alias("explanation"),
    )


# The sentences of a report, in the order in which they appear.
USES = "%s uses '%s' while %s uses '%s' for the same concept."
OTHER_FAMILIES = (
    "These languages belong to different families (%s vs %s). "
    "Any similarity is likely due to loanwords or chance resemblance."
)
ALIKE = "These forms show high phonetic similarity (%s), suggesting possible cognate relationship."
DISTINCT = "These forms are phonetically distinct (%s), indicating likely separate origins."
CLUSTERS_WITH = "'%s' clusters with forms in: %s."
DESPITE_CLOSE = (
    "Despite close phylogenetic relationship (distance=%d), these languages diverged lexically for this concept."
)
ALIGNS_WITH_DISTANT = "This difference aligns with distant phylogenetic relationship (distance=%d)."
BRANCH_SPLIT = "This reflects the split between %s and %s branches."
WITHIN_BRANCH = (
    "This variation exists within the %s branch, possibly due to substrate influence, borrowing, or lexical replacement."
)

# When a sentence applies.
ALIKE_ABOVE, DISTINCT_BELOW = 0.7, 0.3
CLOSE_UP_TO, DISTANT_FROM = 2, 5
LANGUAGES_NAMED = 3


def explanation() -> Column:
    """The report sentences that apply, in order."""
    say = F.format_string
    sound, apart = F.col("phonetic"), F.col("tree_distance")
    shown = say("%.2f", F.bround(sound, 2))
    known = lambda name: F.coalesce(name, F.lit("unknown"))
    families = F.col("a_family") != F.col("b_family")
    branch_a, branch_b = known("a_branch"), known("b_branch")

    def companions(s: str) -> Column:
        named = F.transform(F.slice(F.col(f"{s}.cognates"), 1, LANGUAGES_NAMED), lambda x: x["language"])
        some = (F.col("a.leader") != F.col("b.leader")) & (F.size(f"{s}.cognates") > 0)
        return F.when(some, say(CLUSTERS_WITH, F.col(f"{s}.headword"), F.array_join(named, ", ")))

    return F.concat_ws(
        " ",
        say(USES, F.upper("language_a"), F.col("a.headword"), F.upper("language_b"), F.col("b.headword")),
        F.when(families, say(OTHER_FAMILIES, F.col("a_family"), F.col("b_family"))),
        F.when(sound > ALIKE_ABOVE, say(ALIKE, shown)).when(sound < DISTINCT_BELOW, say(DISTINCT, shown)),
        companions("a"),
        companions("b"),
        F.when(apart <= CLOSE_UP_TO, say(DESPITE_CLOSE, apart)).when(apart >= DISTANT_FROM, say(ALIGNS_WITH_DISTANT, apart)),
        F.when(branch_a != branch_b, say(BRANCH_SPLIT, branch_a, branch_b)).otherwise(say(WITHIN_BRANCH, branch_a)),
    )


def explain(entries: DataFrame, concept_id, language_a: str, language_b: str) -> DataFrame:
    """The report row of one concept and two languages, in the asked order of a and b."""
    low, high = sorted((language_a, language_b))
    of_concept = entries.filter(F.col("concept_id") == concept_id)
    report = lexical_differences(of_concept)
    return report.filter((F.col("language_a") == low) & (F.col("language_b") == high))
