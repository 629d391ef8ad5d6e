"""Cleaning and normalising text columns without leaving the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Language names and the codes they stand for.
LANGUAGE_NAMES = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it",
    "portuguese": "pt", "russian": "ru", "polish": "pl", "latin": "la", "greek": "grc",
    "ancient greek": "grc", "sanskrit": "sa", "hindi": "hi", "persian": "fa", "dutch": "nl",
    "swedish": "sv", "norwegian": "no", "danish": "da", "icelandic": "is",
    "proto-indo-european": "pie",
}

# ASCII stand-ins for phonetic letters, position by position.
ASCII_PHONES = "SZTDN@3A"
IPA_PHONES = "ʃʒθðŋəɜɑ"

# Patterns removed by the cleaners, and the code pattern.
HEADWORD_MARKS = "[*†‡§¶]"
PARENTHETICAL = r"\([^)]*\)"
CITATION = r"\[\d+\]"
MARKUP = "<[^>]+>"
IPA_DELIMITERS = r"[\[\]/]"
LANGUAGE_CODE = "^[a-z]{2,3}$"

_ICU = "com.ibm.icu.text.Normalizer"
_UNICODE_FORMS = {
    "NFC": ("compose", False), "NFD": ("decompose", False),
    "NFKC": ("compose", True), "NFKD": ("decompose", True),
}


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form by the ICU library that ships with Spark."""
    method, compat = _UNICODE_FORMS[form]
    call = F.reflect(F.lit(_ICU), F.lit(method), text, F.lit(compat))
    return F.when(text.isNotNull(), call)


def squeeze(text: Column) -> Column:
    """One blank between words, none at the ends; any Unicode white space counts."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def squeeze_loose(text: Column) -> Column:
    """:func:`squeeze` for text that mostly needs none: cheaper tests come first.

    The text is named several times, so give a plain column.
    """
    loose = text.contains("  ") | text.startswith(" ") | text.endswith(" ") | text.rlike(r"(?U)[^\S ]")
    return F.when(loose, squeeze(text)).otherwise(text)


def _drop(text: Column, pattern: str, needs: str) -> Column:
    """Removes a pattern; text without the sign it needs is not searched for it."""
    return F.when(text.contains(needs), F.regexp_replace(text, pattern, "")).otherwise(text)


def strip_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def clean_ipa(ipa: Column) -> Column:
    bare = F.regexp_replace(unicode_form(strip_blank(ipa)), IPA_DELIMITERS, "")
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def normalize_text(
    text: Column,
    lowercase: bool = True,
    remove_punctuation: bool = False,
    normalize_whitespace: bool = True,
    form: str | None = "NFC",
) -> Column:
    out = unicode_form(text, form) if form in _UNICODE_FORMS else text
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = F.regexp_replace(out, r"(?U)[^\w\s]", "")
    return squeeze(out) if normalize_whitespace else out


def clean_headword(word: Column) -> Column:
    bare = F.regexp_replace(word, f"{HEADWORD_MARKS}|{PARENTHETICAL}", "")
    return squeeze(unicode_form(bare))


def drop_citations(text: Column) -> Column:
    return _drop(text, CITATION, "[")


def drop_markup(text: Column) -> Column:
    return _drop(text, MARKUP, "<")


def clean_definition(
    text: Column, remove_citations: bool = True, max_length: int | None = None
) -> Column:
    out = squeeze(drop_markup(drop_citations(text) if remove_citations else text))
    if not max_length:
        return out
    cut = F.regexp_replace(F.substring(out, 1, max_length), " [^ ]*$", "")
    return F.when(F.length(out) > max_length, F.concat(cut, F.lit("..."))).otherwise(out)


def clean_language(code: Column) -> Column:
    low = strip_blank(F.lower(code))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, low), low)


def strip_diacritics(text: Column) -> Column:
    """Base letters only; scripts without a decomposition are left as they are."""
    return F.regexp_replace(unicode_form(text, "NFD"), r"\p{M}+", "")


_STEPS = {
    "nfc": lambda c: unicode_form(c, "NFC"),
    "nfd": lambda c: unicode_form(c, "NFD"),
    "lowercase": F.lower,
    "strip_diacritics": strip_diacritics,
    "strip_punctuation": lambda c: F.regexp_replace(c, r"[\p{P}$+<=>^`|~]", ""),
}


def apply_steps(text: Column, steps: Iterable[str] = ("nfc", "lowercase")) -> Column:
    for step in steps:
        text = _STEPS[step](text) if step in _STEPS else text
    return text


def ascii_to_ipa(text: Column) -> Column:
    return F.translate(text, ASCII_PHONES, IPA_PHONES)


def valid_text(text: Column) -> Column:
    return not_blank(text)


def valid_definition(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?sU)\S.+\S"), F.lit(False))


def valid_language(code: Column) -> Column:
    return F.coalesce(F.lower(code).rlike(LANGUAGE_CODE), F.lit(False))


def valid_ipa(ipa: Column) -> Column:
    """At least one letter is left once stress, length and tone marks are gone."""
    return F.coalesce(F.regexp_replace(ipa, r"[\p{M}\p{Lm}\s]", "").rlike(r"\p{L}"), F.lit(False))


def well_formed_ipa(ipa: Column) -> Column:
    """Only letters, combining marks, modifier signs, tone bars and separators."""
    return F.coalesce(ipa.rlike(r"^[\p{L}\p{M}\p{Sk} .‿|‖↗↘ꜛꜜ]+$"), F.lit(False))


def concept_label(definition: Column, concept_id: Column) -> Column:
    """First three words, joined and upper-cased; the id where there is no definition."""
    words = F.slice(F.split(squeeze(definition), " "), 1, 3)
    label = F.upper(F.array_join(words, "_"))
    return F.when(definition.isNull(), F.concat(F.lit("concept_"), concept_id)).otherwise(label)


def segment_class(features: Column) -> Column:
    return (
        F.when(F.try_element_at(features, F.lit("syl")) == 1, "vowel")
        .when(F.try_element_at(features, F.lit("son")) == -1, "consonant")
        .otherwise("sonorant")
    )
