"""Chains of cleaners over one column, with validity and provenance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, functions as F

from glossweave.functions import text
from glossweave.session import settle


@dataclass(frozen=True)
class Cleaner:
    """A named step. ``parts``, where given, are the stages ``clean`` consists of."""

    name: str
    clean: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    parts: tuple[Callable[[Column], Column], ...] = ()
    version: str = "1.0.0"

    @property
    def signature(self) -> str:
        return f"{self.name}:{self.version}"


@dataclass(frozen=True)
class Chain:
    """Cleaners in order. A strict chain rejects a value that fails after any step."""

    steps: tuple[Cleaner, ...]
    strict: bool = True

    def then(self, other: Chain) -> Chain:
        return Chain(self.steps + other.steps, self.strict and other.strict)

    @property
    def signature(self) -> str:
        return "_".join(s.signature for s in self.steps)

    def apply(self, df: DataFrame, source: str, out: str | None = None) -> DataFrame:
        """Adds the cleaned column and ``<out>_error``: the first failed step, or null."""
        out = out or source
        return apply_chains(df, {out: self}, {out: source})

    def stages(self) -> list[Callable[[Column, Column], tuple[str, Column]]]:
        """What happens to the pair (value, error), one stage after the other."""
        out = []
        for step in self.steps:
            for part in step.parts or (step.clean,):
                out.append(lambda value, _, part=part: ("value", part(value)))
            if self.strict:
                out.append(lambda value, error, step=step: ("error", F.coalesce(
                    error, F.when(~step.valid(value), f"Validation failed after {step.name}")
                )))
        return out

    def log(self, df: DataFrame, record_id: str, source: str) -> DataFrame:
        """One row per record and step, for the transform log."""
        value, rows = F.col(source), []
        for number, step in enumerate(self.steps, 1):
            value = step.clean(value)
            rows.append(F.struct(
                F.lit(number).alias("step"), F.lit(step.name).alias("step_name"),
                F.lit(step.version).alias("step_version"), step.valid(value).alias("success"), value.alias("value"),
            ))
        return df.select(F.col(record_id).alias("record_id"), F.inline(F.array(*rows)))


def apply_chains(df: DataFrame, chains: dict[str, Chain], sources: dict[str, str] | None = None) -> DataFrame:
    """Several chains side by side: cleaned columns and their ``<column>_error``.

    Each stage is a column of its own, so what a later stage reads twice is
    computed once; all chains take a stage together, which keeps the plan short.
    """
    sources = sources or {}
    begin = {f"_value_{f}": F.col(sources.get(f, f)) for f in chains}
    df = df.withColumns(begin | {f"_error_{f}": F.lit(None).cast("string") for f in chains})
    for level in zip_longest(*(chain.stages() for chain in chains.values())):
        updates = {}
        for field, stage in zip(chains, level):
            if stage:
                kind, column = stage(F.col(f"_value_{field}"), F.col(f"_error_{field}"))
                updates[f"_{kind}_{field}"] = column
        df = df.withColumns(updates)
    done = {f: F.col(f"_value_{f}") for f in chains} | {f"{f}_error": F.col(f"_error_{f}") for f in chains}
    return df.withColumns(done).drop(*[f"_{kind}_{f}" for kind in ("value", "error") for f in chains])


# Step names and versions, as they appear in signatures and logs.
HEADWORD = Cleaner("headword_cleaner", text.clean_headword, text.valid_text)
PLAIN_TEXT = Cleaner(
    "text_normalizer", text.normalize_text, text.valid_text, (text.unicode_form, F.lower, text.squeeze_loose)
)
DEFINITION = Cleaner(
    "definition_cleaner", text.clean_definition, text.valid_definition,
    (text.drop_citations, text.drop_markup, text.squeeze),
)
IPA = Cleaner("ipa_cleaner", text.clean_ipa, text.valid_ipa)
LANGUAGE = Cleaner("language_code_cleaner", text.clean_language, text.valid_language)

CHAINS = {
    "headword": Chain((HEADWORD, PLAIN_TEXT)),
    "ipa": Chain((IPA,)),
    "definition": Chain((DEFINITION, PLAIN_TEXT)),
    "language": Chain((LANGUAGE,)),
}

PIPELINE_VERSION = "_".join(chain.signature for chain in CHAINS.values())


def clean_entries(df: DataFrame, chains: dict[str, Chain] = CHAINS) -> DataFrame:
    """All entry fields cleaned; ``rejects`` lists the fields that failed.

    An absent transcription is no failure: the gate decides about it.
    """
    df = apply_chains(df, chains)
    failed = [
        F.when(F.col(f"{field}_error").isNotNull() & ((F.lit(field) != "ipa") | text.not_blank(F.col("ipa"))),
               F.concat(F.lit(f"{field}: "), F.col(f"{field}_error")))
        for field in chains
    ]
    out = df.withColumn("rejects", F.filter(F.array(*failed), lambda e: e.isNotNull()))
    return settle(out.drop(*[f"{field}_error" for field in chains]))


def split_rejects(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.size("rejects") > 0
    return cleaned.filter(~bad).drop("rejects"), cleaned.filter(bad)
