"""Definitions that projects bring along: their validation, learned sinks, models by tier."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Field, its kind, and whether it must be there.
LANGUAGE_FIELDS = {
    "id": ("string", True), "name": ("string", True), "extensions": ("array", True), "app_types": ("array", False),
    "vuln_profile": ("array", False), "entry_point_patterns": ("array", False), "sink_patterns": ("array", False), "sink_models": ("array", False),
}
#: Characters of a text, or of an element of a list.
MAX_TEXT = 500

TIERS = ("cheap", "mid", "deep")


def schema_errors(definitions: DataFrame, text: str = "json", fields: Mapping[str, tuple[str, bool]] = LANGUAGE_FIELDS, limit: int = MAX_TEXT) -> DataFrame:
    """Adds ``errors``, sorted: what is wrong with the JSON object in ``text``; none if it is valid.

    ``missing x``, ``unknown x`` (no other fields are allowed), ``x is no string`` or
    ``x is no array``, ``x is too long``; ``no object`` alone for anything else.
    """
    raw = F.col(text)
    held = F.from_json(raw, "map<string,string>")
    names = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    found = [F.when(~F.array_contains(names, n), F.lit(f"missing {n}")) for n, (_, must) in fields.items() if must]
    known = F.array(*map(F.lit, fields))
    unknown = F.transform(F.array_except(names, known), lambda n: F.concat(F.lit("unknown "), n))
    for n, (kind, _) in fields.items():
        there = F.array_contains(names, n)
        items = F.from_json(F.get_json_object(raw, f"$.{n}"), "array<string>")
        is_array = F.coalesce(F.json_array_length(F.get_json_object(raw, f"$.{n}")).isNotNull(), F.lit(False))
        value = F.element_at(held, n)
        if kind == "array":
            found.append(F.when(there & ~is_array, F.lit(f"{n} is no array")))
            found.append(F.when(there & is_array & F.exists(items, lambda x: F.length(x) > limit), F.lit(f"{n} is too long")))
        else:
            quoted = raw.rlike(rf'"{n}"\s*:\s*"')
            found.append(F.when(there & ~quoted, F.lit(f"{n} is no string")))
            found.append(F.when(there & quoted & (F.length(value) > limit), F.lit(f"{n} is too long")))
    errors = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*found)), unknown)))
    is_object = F.json_object_keys(raw).isNotNull()
    return definitions.withColumn("errors", F.when(F.coalesce(is_object, F.lit(False)), errors).otherwise(F.array(F.lit("no object"))))


def learn_sinks(samples: DataFrame, covered: DataFrame, learner: Callable[[str, str], list[str]], limit: int = 40) -> DataFrame:
    """(language, pattern): what ``learner(language, sample)`` names for languages without coverage.

    ``samples``: (language, sample), one row per language; ``covered``: (language), those with
    patterns or learned before. Patterns are lower-cased; those of 1 to 100 characters
    count, the first ``limit`` of a language. A learner that fails teaches nothing.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for language, sample in zip(batch["language"], batch["sample"]):
                try:
                    named = learner(language, sample)
                except Exception:  # whatever a plug-in raises; the language stays uncovered
                    continue
                low = (p.strip().lower() for p in named if isinstance(p, str))
                rows += [(language, p) for p in list(dict.fromkeys(p for p in low if 1 <= len(p) <= 100))[:limit]]
            yield pd.DataFrame(rows, columns=["language", "pattern"])

    open_ = samples.join(covered.select("language").distinct(), "language", "left_anti").filter(F.trim("sample") != "")
    return open_.select("language", "sample").mapInPandas(ask, "language string, pattern string")


def models_by_tier(config: Mapping[str, str], provider: str, fallback: Mapping[str, str], legacy_provider: str = "") -> dict[str, str]:
    """The model of each tier: ``<provider>_model_<tier>`` or the fallback's.

    The old key ``model`` still names the middle tier of ``legacy_provider`` where no key of its own does.
    """
    held = {t: config.get(f"{provider}_model_{t}") or fallback.get(t, "") for t in TIERS}
    if provider == legacy_provider and config.get("model") and not config.get(f"{provider}_model_mid"):
        held["mid"] = config["model"]
    return held


def resolve_model(models: Mapping[str, str], tier: str) -> str:
    if not models.get(tier):
        raise ValueError(f"no model is configured for the tier {tier!r}")
    return models[tier]


def definition_json(definition: Mapping) -> str:
    return json.dumps(definition, ensure_ascii=False, sort_keys=True)
