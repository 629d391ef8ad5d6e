"""The list of known sources."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F

FIELDS = (
    "id string, name string, type string, format string, url string, license string, quality string, "
    "priority int, status string, entries_approx long, languages array<string>"
)

# States in which a source cannot be loaded yet.
NOT_READY = ("requires_scraper", "requires_extraction", "deferred")


def load_catalog(spark: SparkSession, toml_text: str) -> DataFrame:
    """Sources of a TOML catalogue, most important first; absent fields are null."""
    names = [field.split()[0] for field in FIELDS.split(", ")]
    rows = [tuple(source.get(n) for n in names) for source in tomllib.loads(toml_text).get("source", [])]
    return spark.createDataFrame(rows, FIELDS).orderBy("priority", "id")


def select_sources(catalog: DataFrame, ids: list[str] | None = None, max_priority: int | None = None) -> DataFrame:
    """Loadable sources: the named ones, else those up to a priority."""
    chosen = catalog
    if ids:
        chosen = catalog.filter(F.col("id").isin(ids))
    elif max_priority is not None:
        chosen = catalog.filter(F.col("priority") <= max_priority)
    return chosen.filter(~F.coalesce(F.col("status").isin(*NOT_READY), F.lit(False)))


def by_priority(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("priority").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("entries_approx").alias("entries_approx")
    )

# Dump file of each language; None where another source serves it.
EXPECTED_FILES = {
    "la": None, "es": "spanish", "pt": "portuguese", "fr": "french", "it": "italian", "ro": "romanian", "ca": "catalan",
    "en": "english", "de": "german", "nl": "dutch", "sv": "swedish", "da": "danish", "no": "norwegian",
    "is": "icelandic", "af": "afrikaans", "yi": "yiddish", "fo": "faroese",
    "ru": "russian", "uk": "ukrainian", "be": "belarusian", "pl": "polish", "cs": "czech", "sk": "slovak",
    "bg": "bulgarian", "mk": "macedonian", "sl": "slovene", "hr": "serbocroatian", "sr": "serbocroatian",
    "sa": None, "hi": "hindi", "ur": "urdu", "bn": "bengali", "pa": "punjabi", "mr": None, "gu": None,
    "fa": "persian", "ps": "pashto", "ku": "northern_kurdish", "tg": "tajik",
    "ga": "irish", "gd": "scottish_gaelic", "cy": "welsh", "br": "breton", "gv": "manx",
    "lt": "lithuanian", "lv": "latvian", "el": "greek", "grc": None, "sq": "albanian", "hy": "armenian",
    "ta": "tamil", "te": "telugu", "kn": "kannada", "ml": "malayalam",
    "fi": "finnish", "et": "estonian", "hu": "hungarian",
}
