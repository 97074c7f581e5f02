"""Small rules over catalog rows, concepts, weights and agents' answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Table families, survey flavors with their descriptions, dimensions of embedding models.
FAMILIES = ["B", "C", "S", "K", "DP", "CP", "SP"]
FLAVORS = {"acs5": "5yr", "acs1": "1yr"}
FLAVOR_TEXTS = {
    "5yr": "5-year estimates: larger sample, more reliable, available for small geographies",
    "1yr": "1-year estimates: smaller sample, less reliable, large geographies only (65K+ population)",
    "3yr": "3-year estimates: discontinued 2015, medium sample size",
}
DIMENSIONS = {"all-mpnet-base-v2": 768, "all-MiniLM-L6-v2": 384, "all-MiniLM-L12-v2": 384, "all-distilroberta-v1": 768, "paraphrase-mpnet-base-v2": 768, "sentence-t5-base": 768, "sentence-t5-large": 768}
#: An agreement below this goes to an arbiter.
ARBITRATE_BELOW = 0.4


def lookup(value: Column, pairs: dict, default: Column) -> Column:
    """The value's entry in a small fixed table; the default for others and for null."""
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), default)


def in_family(variable_id: Column) -> Column:
    return F.coalesce(variable_id.rlike(f"^(?:{'|'.join(FAMILIES)})"), F.lit(False))


def is_base_table(variable_id: Column) -> Column:
    """Whether an id is of a B or C table and has a number."""
    return F.coalesce(variable_id.rlike("^[BC]") & variable_id.contains("_"), F.lit(False))


def is_described(text: Column) -> Column:
    return F.coalesce(F.length(text) > 10, F.lit(False))


def needs_category(category: Column) -> Column:
    return F.coalesce(category, F.lit("other")) == "other"


def flavor(survey: Column) -> Column:
    """The survey's flavor; an unknown survey is its own."""
    return lookup(survey, FLAVORS, survey)


def flavor_text(survey: Column) -> Column:
    own = flavor(survey)
    return lookup(own, FLAVOR_TEXTS, F.concat(F.lit("Unknown flavor: "), F.coalesce(own, F.lit("None"))))


def embedding_dimension(model: Column) -> Column:
    return lookup(model, DIMENSIONS, F.lit(768))


def joined_parts(*parts: Column, glue: str = " | ") -> Column:
    """Parts that aren't null or blank, joined; empty if there are none."""
    return F.array_join(F.filter(F.array(*[p.cast("string") for p in parts]), lambda p: p.isNotNull() & (F.trim(p) != "")), glue)


def clean_definition(text: Column) -> Column:
    """White space put right, and a page number at the end left out."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n]+", " "), r"[0-9]+$", ""))


def page_of(section: Column, pages: dict[str, int]) -> Column:
    return lookup(section, pages, F.lit(1))


def uncertainty(agreement: Column) -> Column:
    return 1 - agreement


def geography_weight(linear: Column, log: Column, category: str = "geography") -> Column:
    """The category's linear weight, else its log weight, else null."""
    return F.coalesce(F.try_element_at(linear, F.lit(category)), F.try_element_at(log, F.lit(category)))


def review_decision(level: Column) -> Column:
    """decision, confidence, complexity of a concept that needs no review; null for others."""
    return F.when(level == "high", F.struct(F.lit("approve").alias("decision"), F.lit(1.0).alias("confidence"), F.lit("simple").alias("complexity")))


def arbitration(agreement: Column) -> Column:
    """Whether an agreement is so low that an arbiter decides; a missing one isn't."""
    return F.coalesce(agreement < ARBITRATE_BELOW, F.lit(False))


def synthesis(answers: Column) -> Column:
    """One text of an array of structs (agent, response): the only response, or all under their agents' names; null for none."""
    names = F.array_join(F.transform(answers, lambda a: a["agent"]), ", ")
    parts = F.transform(answers, lambda a: F.concat(F.lit("**"), F.initcap(F.replace(a["agent"], F.lit("_"), F.lit(" "))), F.lit(" Analysis:**\n"), a["response"], F.lit("\n")))
    whole = F.concat(F.lit("Multi-specialist analysis from: "), names, F.lit("\n\n"), F.array_join(parts, "\n"))
    return F.when(F.size(answers) == 1, F.get(answers, F.lit(0))["response"]).when(F.size(answers) > 1, whole)


def official_text(variable_id: Column, official: Column, label: Column, concept: Column, survey: Column) -> Column:
    """The embedding text of a record, and where it is from: official (a struct of label, concept, survey, or null) first, else its own fields."""
    unknown = lambda c, other: F.when(F.coalesce(c, F.lit("Unknown")) == "Unknown", other).otherwise(c)
    own = F.struct(unknown(label, F.concat(F.lit("Variable "), variable_id)).alias("label"), unknown(concept, F.lit("Census Variable")).alias("concept"), F.coalesce(survey, F.lit("acs5")).alias("survey"))
    pick = lambda f: F.when(official.isNotNull(), official[f]).otherwise(own[f])
    text = F.trim(F.concat_ws(" ", F.concat(F.lit("V_ID_"), variable_id), pick("label"), pick("concept"), pick("survey")))
    return F.struct(text.alias("text"), F.when(official.isNotNull(), "OFFICIAL").otherwise("FALLBACK").alias("source"))
