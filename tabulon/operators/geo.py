"""Locations, geography levels and advice on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.functions.stats import moe_ratio_band, spatial_category
from tabulon.operators.patterns import contained
from tabulon.sources.tables import literals

# States with their abbreviations, city aliases, levels from coarse to fine.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia", "PR": "Puerto Rico",
}
CITIES = [
    ("new york", "NY", "New York city"), ("new york city", "NY", "New York city"), ("nyc", "NY", "New York city"), ("los angeles", "CA", "Los Angeles city"), ("la", "CA", "Los Angeles city"),
    ("chicago", "IL", "Chicago city"), ("houston", "TX", "Houston city"), ("philadelphia", "PA", "Philadelphia city"), ("phoenix", "AZ", "Phoenix city"), ("san antonio", "TX", "San Antonio city"),
    ("san diego", "CA", "San Diego city"), ("dallas", "TX", "Dallas city"), ("san jose", "CA", "San Jose city"), ("baltimore", "MD", "Baltimore city"), ("boston", "MA", "Boston city"),
    ("washington", "DC", "Washington city"), ("dc", "DC", "Washington city"),
]
NATION = ["united states", "usa", "us", "america"]
LEVELS = ["us", "state", "county", "place", "tract", "block_group"]


def state_code(text: Column) -> Column:
    """The abbreviation of a state given by abbreviation or name, in any case; else null."""
    t = F.lower(F.trim(text))
    pairs = F.create_map(*[x for k, v in STATES.items() for key in (k.lower(), v.lower()) for x in (F.lit(key), F.lit(k))])
    return F.try_element_at(pairs, t)


def parse_location(places: DataFrame, location: str = "location") -> DataFrame:
    """places with geography, state, county and place: nation, known city, `X, ST`, state, or a city of any state."""
    t = F.trim(F.col(location))
    low = F.lower(t)
    city_state = F.create_map(*[x for a, s, _ in CITIES for x in (F.lit(a), F.lit(s))])
    city_name = F.create_map(*[x for a, _, p in CITIES for x in (F.lit(a), F.lit(p))])
    parts = F.transform(F.split(t, ","), lambda x: F.trim(x))
    name, code = parts[0], F.when(F.size(parts) == 2, state_code(F.get(parts, F.lit(1))))
    county = F.lower(name).contains("county")
    nation, known, whole = low.isin(*NATION), F.try_element_at(city_state, low), state_code(t)
    suffixed = lambda c, words: F.when(F.lower(c).rlike("|".join(words)), c).otherwise(F.concat(c, F.lit(" city")))
    none = F.lit(None).cast("string")
    geography = F.when(nation, "us").when(known.isNotNull(), "place").when(code.isNotNull(), F.when(county, "county").otherwise("place")).when(whole.isNotNull(), "state").otherwise("place")
    return places.withColumns({
        "geography": geography,
        "state": F.when(nation, none).otherwise(F.coalesce(known, code, whole)),
        "county": F.when(~nation & known.isNull() & code.isNotNull() & county, F.regexp_replace(name, " [Cc]ounty", "")),
        "place": F.when(nation, none).when(known.isNotNull(), F.try_element_at(city_name, low)).when(code.isNotNull(), F.when(county, none).otherwise(suffixed(name, ["city", "town", "village"]))).when(whole.isNotNull(), none).otherwise(suffixed(t, ["city", "town", "village", "county"])),
    })


def location_confidence(location: Column) -> Column:
    low = F.lower(F.trim(location))
    sure = ["new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "san jose", "baltimore"]
    return F.when(low.isin(*sure), "high").when(low.rlike("springfield|washington|baltimore"), "low").otherwise("medium")


def name_state(name: Column) -> Column:
    """The state that a name like `Springfield city, Illinois` ends with; null if it ends with none."""
    return F.when(name.contains(","), state_code(F.substring_index(name, ",", -1)))


def match_places(asked: DataFrame, names: DataFrame, place: str = "place", name: str = "name", state: str | None = None) -> DataFrame:
    """Names that match each place by the first rule that has any: whole, before a comma, with a suffix, or containing its base.

    state: a column of asked; a place of a known state is matched with the names of that state alone, and with names that
    end with no state. Both sides may have any size.
    """
    p, n = F.lower(place), F.lower(name)
    base = F.regexp_replace(p, " (city|town|village)$", "")
    rule = F.when(n == p, 1).when(n.startswith(F.concat(p, F.lit(","))), 2)
    for i, suffix in enumerate((" city,", " town,", " village,"), 3):
        rule = rule.when(n.contains(F.concat(p, F.lit(suffix))), i)
    rule = rule.when(n.contains(base), 6)
    # Every rule asks for the base, so names and places meet where the name contains it (see patterns).
    low, bases = names.withColumn("_n", n), asked.withColumn("_b", base)
    met = low.join(contained(low, "_n", bases, "_b"), "_n").join(bases, "_b").withColumn("rule", rule).filter("rule IS NOT NULL").drop("_n", "_b")
    if state:
        own = name_state(F.col(name))
        met = met.filter(F.col(state).isNull() | own.isNull() | (own == F.col(state)))
    best = F.min("rule").over(W.Window.partitionBy(place, *([state] if state else [])))
    return met.withColumn("_best", best).filter("rule = _best").drop("_best")


def levels(spark: SparkSession) -> DataFrame:
    return literals(spark, "level string", [(x,) for x in LEVELS]).withColumnRenamed("ordinal", "rank")


def coarser_levels(requests: DataFrame, available: DataFrame, dim: DataFrame) -> DataFrame:
    """Per request (request_id, table_id, level) its coarser levels that the table has (table_id, level), from coarse to fine.

    An unknown level gives all available ones.
    """
    ranked = requests.join(F.broadcast(dim.select("level", F.col("rank").alias("own_rank"))), "level", "left")
    there = available.join(F.broadcast(dim), "level").select("table_id", F.col("level").alias("coarser"), "rank")
    near = ranked.join(there, "table_id").filter(F.col("own_rank").isNull() | (F.col("rank") < F.col("own_rank")))
    return near.groupBy("request_id").agg(F.array_sort(F.collect_set(F.struct("rank", "coarser"))).getField("coarser").alias("coarser"))


def advise(requests: DataFrame, available: DataFrame, weights: DataFrame, dim: DataFrame, moe_resolver: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """request_id, status, reason, suggestion, note of requests (request_id, variable_id, table_id, level, moe_ratio).

    moe_resolver gives the margin's ratio as a column of the requests, in place of their own moe_ratio; a null ratio warns of nothing.
    """
    if moe_resolver:
        requests = requests.withColumn("moe_ratio", moe_resolver(requests))
    there = available.select("table_id", "level").distinct().withColumn("_there", F.lit(True))
    joined = requests.join(there, ["table_id", "level"], "left").join(weights, "variable_id", "left").join(coarser_levels(requests, available, dim), "request_id", "left")
    blocked = F.col("_there").isNull()
    noisy = moe_ratio_band(F.col("moe_ratio")) == "low"
    kind = spatial_category(F.col("weight"))
    note = F.when((kind == "locally_clustered") & F.col("level").isin("county", "state"), kind).when((kind == "nationally_stable") & F.col("level").isin("tract", "block_group"), kind)
    status = F.when(F.col("variable_id").isNull() | F.col("level").isNull(), "error").when(blocked, "blocked").when(F.coalesce(noisy, F.lit(False)), "warning").otherwise("ok")
    return joined.select("request_id", status.alias("status"), F.when(status == "blocked", "not_published").when(status == "warning", "high_moe").alias("reason"), F.when(status == "blocked", F.array_join("coarser", ", ")).when(status == "warning", F.coalesce(F.get("coarser", F.lit(0)), F.lit("coarser geography"))).alias("suggestion"), F.when(status == "ok", note).alias("note"))
