"""Validation rules and quality scores.

A rule is a column that holds the error text where the row fails, else null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glossweave.functions.text import not_blank

# Codes the language rule accepts.
KNOWN_CODES = (
    "en de nl sv no da is fo fr es it pt ro ca la ru pl cs sk uk bg lt lv grc el "
    "sa hi ur fa ku ps ga cy br sga sq hy pie ine"
).split()

# Marks that make a digit in a transcription acceptable.
LENGTH_MARKS = "[ː̯̥̆̊]"


# Error texts.
REQUIRED = "%s is required"
TOO_SHORT = "%s must be at least %d characters"
TOO_LONG = "%s must be at most %d characters"
IPA_EMPTY = "IPA transcription is empty"
IPA_DIGITS = "IPA contains suspicious numeric characters"
IPA_BRACKETS = "IPA has unbalanced brackets"
UNKNOWN_CODE = "Unknown or non-Indo-European language code: %s"


def required(field: str) -> Column:
    return F.when(~not_blank(F.col(field).cast("string")), REQUIRED % field)


def _length(field: str) -> Column:
    return F.length(F.coalesce(F.col(field), F.lit("")))


def min_length(field: str, n: int) -> Column:
    return F.when(_length(field) < n, TOO_SHORT % (field, n))


def max_length(field: str, n: int) -> Column:
    return F.when(_length(field) > n, TOO_LONG % (field, n))


def matches(field: str, pattern: str, description: str) -> Column:
    hit = F.coalesce(F.col(field), F.lit("")).rlike(f"^(?:{pattern})")
    return F.when(~hit, f"{field} {description}")


def sound_ipa(field: str = "ipa") -> Column:
    ipa = F.coalesce(F.col(field), F.lit(""))
    count = lambda mark: F.length(ipa) - F.length(F.replace(ipa, F.lit(mark), F.lit("")))
    digits = ipa.rlike("[0-9]") & ~ipa.rlike(LENGTH_MARKS)
    return F.when(~not_blank(ipa), IPA_EMPTY).when(digits, IPA_DIGITS).when(count("[") != count("]"), IPA_BRACKETS)


def known_language(field: str = "language") -> Column:
    code = F.lower(F.coalesce(F.col(field), F.lit("")))
    return F.when(~code.isin(KNOWN_CODES), F.format_string(UNKNOWN_CODE, code))


def standard_rules() -> list[Column]:
    return [
        *map(required, ("headword", "ipa", "language", "definition")),
        min_length("headword", 1), min_length("definition", 3),
        max_length("headword", 255), max_length("ipa", 255),
        sound_ipa(), known_language(),
    ]


def strict_rules() -> list[Column]:
    return [
        *map(required, ("headword", "ipa", "language", "definition", "etymology", "pos_tag")),
        min_length("headword", 1), min_length("definition", 10), min_length("etymology", 5),
        max_length("headword", 255), max_length("ipa", 255),
        sound_ipa(), known_language(),
    ]


def permissive_rules() -> list[Column]:
    return [required("headword"), required("language"), min_length("headword", 1)]


RULE_SETS = {"standard": standard_rules, "strict": strict_rules, "permissive": permissive_rules}


def errors(rules: list[Column]) -> Column:
    return F.filter(F.array(*rules), lambda e: e.isNotNull())


def rule_score(n_errors: Column) -> Column:
    return F.when(n_errors == 0, 1.0).otherwise(1.0 - F.least(n_errors * 0.15, F.lit(0.9)))


def entry_quality(
    etymology: Column, pos_tag: Column, embedding: Column, n_errors: Column, definition: Column
) -> Column:
    """Completeness of a typed entry, 1 at best and 0 at worst."""
    miss = lambda cond, cost: F.when(cond, F.lit(cost)).otherwise(F.lit(0.0))
    score = (
        F.lit(1.0)
        - miss(etymology.isNull(), 0.1)
        - miss(pos_tag.isNull(), 0.1)
        - miss(embedding.isNull(), 0.2)
        - F.coalesce(n_errors, F.lit(0)) * 0.1
        - miss(F.length(definition) < 10, 0.2)
    )
    return F.greatest(F.lit(0.0), score)


def passes_gate(min_definition: int = 10, require_ipa: bool = False) -> Column:
    """Quality gate in front of the typed table."""
    ok = not_blank(F.col("headword")) & not_blank(F.col("definition"))
    ok = ok & (F.length("definition") >= min_definition)
    return ok & not_blank(F.col("ipa")) if require_ipa else ok


def quality_tier(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score >= 0.5, "medium").otherwise("low")
