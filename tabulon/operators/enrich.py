"""Operators on enriched variables: agreement of two analyses, domain weights, validation, categories by key and prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.vector import cosine


def clamped_cosine(a: Column, b: Column, fallback: float = 0.5) -> Column:
    """Cosine of two vectors within 0 and 1; the fallback where there is none."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b))), F.lit(fallback))


def agreement(similarities: Column, confidence_a: Column, confidence_b: Column) -> Column:
    """Mean of the field similarities that are there and of the confidences' agreement. Missing confidences count 0.5."""
    near = 1.0 - F.abs(F.coalesce(confidence_a, F.lit(0.5)) - F.coalesce(confidence_b, F.lit(0.5)))
    parts = F.concat(F.filter(similarities, lambda x: x.isNotNull()), F.array(near))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)


def agreement_method(score: Column) -> Column:
    return F.when(score > 0.8, "high_agreement_merge").when(score > 0.5, "collaborative_resolution").otherwise("arbitration_required")


def merged_field(score: Column, a: Column, b: Column, confidence_a: Column, confidence_b: Column, names: tuple[str, str] = ("A", "B")) -> Column:
    """One text of two by their agreement: both, the surer one first, or a note that they disagree. Nulls are empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    both = F.when((a != "") & (b != ""), F.concat(F.lit(f"{names[0]}: "), a, F.lit(f" | {names[1]}: "), b)).otherwise(F.concat(a, b))
    first, second = F.when(confidence_a > confidence_b, a).otherwise(b), F.when(confidence_a > confidence_b, b).otherwise(a)
    ranked = F.concat(F.lit("PRIMARY: "), first, F.lit(" | SECONDARY: "), second)
    return F.when(score > 0.8, both).when(score > 0.5, ranked).otherwise(F.concat(F.lit(f"DISAGREEMENT - {names[0]}: "), a, F.lit(f" | {names[1]}: "), b))


def merged_confidence(score: Column, a: Column, b: Column) -> Column:
    return F.when(score > 0.8, (a + b) / 2).when(score > 0.5, F.greatest(a, b) * 0.9).otherwise(F.lit(0.3))


def unknown_domains(weights: Column, known: list[str]) -> Column:
    """Keys of a map of weights that are no known domains."""
    return F.array_except(F.map_keys(weights), F.array(*[F.lit(k) for k in known]))


def weights_accepted(weights: Column, known: list[str], most: int = 4) -> Column:
    """Whether a map of weights has few domains, all known, that sum to 1."""
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda s, x: s + x)
    return (F.size(weights) <= most) & (F.abs(total - 1.0) < 1e-6) & (F.size(unknown_domains(weights, known)) == 0)


def weight_issues(weights: Column, known: list[str], most: int = 4) -> Column:
    """What is wrong with a map of weights, as an array: too many or no domains, unknown ones, negative weights, a sum that isn't 1. A null map has none."""
    values = F.map_values(weights)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    bad = F.array_sort(unknown_domains(weights, known))
    checks = [
        F.when(F.size(weights) == 0, "no domains"), F.when(F.size(weights) > most, "too many domains"), F.when(F.size(bad) > 0, F.concat(F.lit("unknown domains: "), F.array_join(bad, ", "))),
        F.when(F.exists(values, lambda x: x < 0), "negative weights"), F.when((F.size(weights) > 0) & (F.abs(total - 1.0) >= 1e-6), F.concat(F.lit("weights sum to "), F.format_string("%.3f", total))),
    ]
    return F.when(weights.isNotNull(), F.filter(F.array(*checks), lambda x: x.isNotNull()))


def primary_domain(weights: Column) -> Column:
    """The domain of the largest weight, the first of equal ones."""
    ranked = F.transform(F.map_entries(weights), lambda e, i: F.struct(e["value"].alias("w"), (-i).alias("i"), e["key"].alias("k")))
    return F.array_max(ranked)["k"]


def concept_errors(label: Column, confidence: Column, status: Column) -> Column:
    """What is wrong with a concept record, as an array; empty if nothing is."""
    checks = [
        F.when(label.isNull(), "missing label"),
        F.when(confidence.isNull(), "missing confidence").when((confidence < 0) | (confidence > 1), "confidence must be between 0 and 1"),
        F.when(status.isNull(), "missing status").when(~status.isin("auto", "reviewed", "rejected"), "unknown status"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def category_by_prefix(rows: DataFrame, key: str, dim: DataFrame, default: str = "uncategorized") -> DataFrame:
    """rows with `category`: of the equal key of dim (key, category, ordinal), else of its first key that begins the row's.

    Prefixes are cut at the lengths that dim has, which are no more than its longest key has characters, so both steps are
    joins on equal values. Rows without a key get the default, keys of dim that are null or empty count as none, and of
    equal keys that of the least ordinal counts. Repeated rows are repeated; an empty dim gives the default.
    """
    dim = dim.filter(F.length(key) > 0)
    lengths = sorted(r[0] for r in dim.select(F.length(key)).distinct().collect())
    cuts = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))
    heads = rows.select(key).distinct().select(F.col(key).alias("_whole"), F.explode(cuts).alias(key))
    rank = F.struct((F.col("_whole") != F.col(key)).alias("prefix"), "ordinal")
    best = heads.join(dim, key).groupBy("_whole").agg(F.min_by("category", rank).alias("category"))
    out = rows.join(best, F.col(key) == F.col("_whole"), "left").drop("_whole")
    return out.withColumn("category", F.coalesce("category", F.lit(default)))


def enrichment_text(record: Column) -> Column:
    """Texts of a JSON record whose fields are strings or objects, joined by bars."""
    field = lambda name: F.nullif(F.trim(F.coalesce(F.get_json_object(record, f"$.{name}"), F.lit(""))), F.lit(""))
    plain = lambda name: F.when(~F.coalesce(field(name), F.lit("")).startswith("{"), field(name))
    inner = [F.when(field(f"analysis.{k}").isNotNull(), F.concat(F.lit(f"{k}: "), field(f"analysis.{k}"))) for k in ("summary", "concept", "statistical_method", "limitations", "methodology_notes")]
    text = F.concat_ws(" | ", plain("enrichment"), plain("analysis"), *inner, plain("summary"), plain("description"))
    return F.when(text == "", "No enrichment available").otherwise(text)
