"""Classification and enrichment of catalog variables, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.text import keywords, lower_of

# Aliases of keywords, terms that raise relevance, and the patterns and tables of useful variables.
ALIASES = {
    "income": ["salary", "earnings", "wages", "pay", "money"],
    "population": ["people", "residents", "inhabitants"],
    "housing": ["home", "house", "property"],
    "value": ["cost", "price", "worth"],
    "unemployment": ["jobless", "unemployed"],
    "education": ["school", "college", "university"],
    "bachelor": ["college degree", "university degree"],
    "rent": ["rental"],
    "occupation": ["job", "work", "career"],
    "earnings": ["income", "salary", "pay"],
}
HIGH_VALUE = ["median", "total", "population", "income", "housing", "education"]
RACE_TERMS = ["white", "black", "asian", "hispanic", "latino"]
EXCLUDED = ["annotation|flag|status", "margin of error", "universe"]
PRIORITY = [
    "total.*population|population.*total", "median age|age.*median", "median.*income|income.*median", "poverty|below.*poverty", "unemployment|unemployed",
    "median.*value|value.*median|home.*value", "median.*rent|rent.*median", "housing.*units|units.*housing", "bachelor|college|university|degree|education",
    "high school|diploma", "white alone|black.*african american|asian alone|american indian|hispanic.*latino", "occupation.*earnings|earnings.*occupation",
    "management.*earnings|education.*earnings|healthcare.*earnings",
]
PRIORITY_TABLES = ["B01003", "B19013", "B25077", "B25064", "B17001", "B23025", "B15003", "B24080", "B02001", "B03003", "B01002", "B25001", "B25003"]
RESERVED_IDS = ["for", "in", "ucgid", "NAME"]
VARIABLE_ID = r"^[A-Z][0-9]{5}_[0-9]{3}[A-Z]?$"


def ordered_case(text: Column, arms: list[tuple[list[str], str]], default: str) -> Column:
    """The first arm of which some word is a substring of text."""
    out = F.lit(default)
    for words, name in reversed(arms):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def measure_type(label: Column) -> Column:
    arms = [(["median"], "median"), (["mean", "average"], "mean"), (["total", "count"], "total"), (["percentage", "percent"], "percentage"), (["rate"], "rate")]
    return ordered_case(F.lower(F.coalesce(label, F.lit(""))), arms, "count")


def complexity(label: Column) -> Column:
    arms = [(["total"], "simple_count"), (["percent", "rate"], "calculated_rate"), (["median"], "statistical_measure")]
    return ordered_case(F.lower(F.coalesce(label, F.lit(""))), arms, "unknown")


def domain(concept: Column) -> Column:
    arms = [(["income", "earnings"], "economics"), (["housing", "rent"], "housing"), (["education", "school"], "education"), (["employment", "labor"], "employment"), (["race", "ethnicity"], "demographics"), (["age", "sex"], "demographics")]
    return ordered_case(F.lower(F.coalesce(concept, F.lit(""))), arms, "other")


def is_variable(variable_id: Column, label: Column) -> Column:
    return label.isNotNull() & ~variable_id.isin(*RESERVED_IDS) & variable_id.rlike(VARIABLE_ID)


def is_useful(variable_id: Column, label: Column, concept: Column) -> Column:
    """Excluded texts first; then priority texts, then priority tables."""
    text = lower_of(label, concept)
    matches = lambda patterns: text.rlike("|".join(f"(?:{p})" for p in patterns))
    return ~matches(EXCLUDED) & (matches(PRIORITY) | F.substring(variable_id, 1, 6).isin(*PRIORITY_TABLES))


def aliases(words: Column, label: Column) -> Column:
    """Distinct, sorted aliases of the keywords, with the phrases that follow from some of them."""
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    some = lambda when, phrases: F.when(when, F.array(*map(F.lit, phrases))).otherwise(F.array().cast("array<string>"))
    has = lambda w: F.array_contains(words, w)
    more = F.concat(some(has("income") | has("earnings"), ["make", "earn", "get paid"]), some(has("population"), ["how many people", "live"]), some(has("value") & F.lower(label).contains("home"), ["expensive", "cost of housing"]))
    return F.array_sort(F.array_distinct(F.concat(own, more)))


def relevance(words: Column, label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.size(F.array_intersect(words, F.array(*map(F.lit, HIGH_VALUE)))).cast("double")
        + F.when(low.contains("median"), 2.0).when(low.contains("mean"), 0.5).otherwise(0.0)
        + F.when(F.array_contains(words, "occupation") & F.array_contains(words, "earnings"), 1.5).otherwise(0.0)
        + F.when(F.arrays_overlap(words, F.array(*map(F.lit, RACE_TERMS))), 1.0).otherwise(0.0)
    )


def enriched(catalog):
    """The catalog with keywords, measure type, aliases, search text and relevance of each variable."""
    words = keywords(lower_of(F.col("label"), F.col("concept")))
    out = catalog.withColumn("semantic_keywords", words).withColumn("measure_type", measure_type(F.col("label"))).withColumn("aliases", aliases(F.col("semantic_keywords"), F.col("label")))
    search = lower_of(F.col("label"), F.col("concept"), F.array_join("semantic_keywords", " "), F.array_join("aliases", " "))
    return out.withColumn("search_text", search).withColumn("relevance", relevance(F.col("semantic_keywords"), F.col("label")))
