"""Secrets in texts, and weak parts of credentials linked by what stands near them.

Three kinds are reported wherever they match. Weak candidates - identifiers,
secrets and endpoints that mean little alone - are found by looser patterns and
reported only when their complement lies within ``window`` code points: an
identifier or endpoint needs a secret, a secret needs an identifier or endpoint.
Strong matches count as complements as well. The interval join works on bins of
the window's width, which hold the outermost places of each part, so a text full
of candidates costs no more than its candidates.

Everything is a DataFrame expression. Positions are code points, ends exclusive.

Defined cases: null counts as an empty text and has no spans. Equal rows get
equal results, once each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glossweave.session import materialize

# The patterns of the strong kinds, in the order in which kinds are listed.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = {
    "assign": (ASSIGN, r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}$"),
    # A run that is too short has no longer one inside it, so the length stands in the pattern.
    "access": (r"AKIA[A-Z0-9]{12,}", r"."),
    "hex": (r"[0-9a-f]{32,}", r"."),
}
# The patterns of weak parts, each with a test of the match.
WEAK = {
    "id": (
        r"""(?:[cC]lient|[aA]ccess|[aA]ccount|[uU]ser|[aA]pp)[_-]?(?:[kK]ey[_-]?)?(?:[iI][dD]|[nN]ame)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}|A(?:SIA|ROA|IDA)[A-Z0-9]{12,}""",
        r".",
    ),
    "key": (
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}",
        r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])",
    ),
    "endpoint": (
        r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp|s3)://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+|(?:[hH]ost|[eE]ndpoint|[sS]erver)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{4,}""",
        r".",
    ),
}
KINDS = [*STRONG, *WEAK]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "key": "secret", "endpoint": "place"}
# A cheap test that every text with a span passes.
MAYBE = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA|[0-9a-f]{32}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20}|://|A(?:SIA|ROA|IDA)"""
    r"""|(?:[iI][dD]|[nN]ame|[hH]ost|[eE]ndpoint|[sS]erver)["']?\x20*[:=]"""
)
WINDOW = 200


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return own.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})


def spans(texts: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, stop) of all strong and weak matches; texts are distinct by key."""
    found = []
    for kind, (pattern, test) in (STRONG | WEAK).items():
        # A filter on the text first, so that the arrays are made only where something matches.
        hit = texts.filter(F.col("text").rlike(pattern))
        parts = F.arrays_zip(
            F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match")
        )
        rows = hit.select("k1", "k2", F.posexplode(parts).alias("i", "p"))
        rows = rows.select(
            "k1", "k2", F.lit(kind).alias("kind"), "i", F.length("p.gap").alias("gap"), F.length("p.match").alias("length"),
            F.coalesce(F.col("p.match").rlike(test), F.lit(False)).alias("real"),
        )
        found.append(rows)
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    before = Window.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.coalesce("length", F.lit(0))).over(before)
    return every.withColumn("stop", stop).filter("real").select("k1", "k2", "kind", (F.col("stop") - F.col("length")).alias("start"), "stop")


def near(found: DataFrame, window: int) -> DataFrame:
    """The weak spans with their complement within the window: the distance between the two intervals is at most that."""
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]
    parts = found.withColumn("role", role)
    # A part stands in every bin it touches.
    bins = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor((F.col("stop") - 1) / window))))
    keys = ["k1", "k2", "bin"]
    outer = bins.groupBy(*keys).agg(*[
        f(F.when(F.col("role") == r, F.col(c))).alias(f"{c}_{r}") for r in ("id", "secret", "place") for f, c in ((F.max, "stop"), (F.min, "start"))
    ])
    weak = parts.filter(F.col("kind").isin(*WEAK))
    first, last = F.floor(F.col("start") / window) - 1, F.floor((F.col("stop") - 1) / window) + 1
    asked = weak.withColumn("bin", F.explode(F.sequence(first, last)))
    met = asked.join(outer, keys)

    def reached(r: str) -> Column:
        # Before, after, or in the same bins (then the distance is less than a bin).
        inside = (F.col("bin") > first) & (F.col("bin") < last) & F.col(f"start_{r}").isNotNull()
        return F.coalesce(inside, F.lit(False)) | F.coalesce(
            ((F.col("bin") <= first) & (F.col(f"stop_{r}") >= F.col("start") - window))
            | ((F.col("bin") >= last) & (F.col(f"start_{r}") <= F.col("stop") + window)), F.lit(False),
        )

    fits = F.when(F.col("role") == "secret", reached("id") | reached("place")).otherwise(reached("secret"))
    return met.filter(fits).select("k1", "k2", "kind", "start", "stop").distinct()


def linked_secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, base (array), spans (array) - one row per input row."""
    rows = keyed(docs)
    texts = rows.filter(F.col("text").rlike(MAYBE)).dropDuplicates(["k1", "k2"])
    found = materialize(spans(texts.select("k1", "k2", "text")), "spans")
    strong = found.filter(F.col("kind").isin(*STRONG))
    # Weak matches that a strong one of the same place already names say nothing new.
    weak = found.join(strong.select("k1", "k2", "start", "stop"), ["k1", "k2", "start", "stop"], "left_anti")
    every = strong.unionByName(near(strong.unionByName(weak.filter(F.col("kind").isin(*WEAK))), window))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    gathered = every.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "stop", "kind"))).alias("found"))
    out = rows.select("doc_id", "k1", "k2").join(gathered, ["k1", "k2"], "left")
    found = F.coalesce("found", F.expr("array()").cast("array<struct<start:bigint,order:bigint,stop:bigint,kind:string>>"))
    out = out.withColumn("found", found)

    def shown(keep: list[str] | None) -> Column:
        spans = F.filter("found", lambda s: s["kind"].isin(*keep)) if keep else F.col("found")
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))

    def count(*kinds: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"].isin(*kinds))).cast("long")

    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in STRONG], count(*WEAK).alias("n_linked"),
        shown(list(STRONG)).alias("base"), shown(None).alias("spans"),
    )
