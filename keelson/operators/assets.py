"""Sightings merged into assets, with confidence, reach and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators import identity

KEYS = ["run_id", "asset_ref"]
_RANKS = {t: i for i, t in enumerate(dims.TIERS)}


def keyed(findings: DataFrame) -> DataFrame:
    """findings with asset_ref, the identity of what is sighted, and rank, that of the strongest evidence (0 is strongest)."""
    rank = F.array_min(F.transform("evidence", lambda e: F.coalesce(dims.lookup(_RANKS, e["tier"]), F.lit(len(_RANKS)))))
    return findings.withColumn("asset_ref", identity.bom_ref(F.col("target_id"), F.col("asset_kind"), F.col("name"), F.col("parameters"))).withColumn("rank", F.coalesce(rank, F.lit(len(_RANKS))))


def noisy_or(counts: dict[str, Column]) -> Column:
    """1 - product of (1 - base) over distinct witnesses, capped and to four places; counts has the witnesses of each tier. 0 without any."""
    left = F.lit(1.0)
    for tier, n in counts.items():
        left = left * F.pow(F.lit(round(1 - dims.TIERS[tier], 2)), n)
    return F.round(F.least(1 - left, F.lit(dims.CEILING)), 4)


def confidence(rows: DataFrame) -> DataFrame:
    """run_id, asset_ref, confidence, n_evidence, tiers, matchers, of keyed rows. The same tier, matcher and snippet is one witness, unknown tiers are none.

    Witnesses are made distinct by a shuffle on all they consist of; what is gathered for an asset is one number for each tier, and its rules' names.
    """
    seen = rows.select(*KEYS, F.explode("evidence").alias("e")).filter(F.col("e.tier").isin(*dims.TIERS)).select(*KEYS, "e.tier", "e.matcher_id", "e.snippet").distinct()
    counts = seen.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_evidence"), *[F.count_if(F.col("tier") == t).alias(t) for t in dims.TIERS], F.array_join(F.array_sort(F.collect_set("matcher_id")), ",").alias("matchers"))
    tiers = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(t) > 0, t) for t in dims.TIERS]))), ",")
    return counts.select(*KEYS, noisy_or({t: F.col(t) for t in dims.TIERS}).alias("confidence"), "n_evidence", tiers.alias("tiers"), "matchers")


def merged_parameters(rows: DataFrame) -> DataFrame:
    """run_id, asset_ref, parameters: of each parameter the value of the strongest, then earliest sighting that has one."""
    values = rows.select(*KEYS, "rank", "seq", F.explode("parameters").alias("k", "v")).filter("v IS NOT NULL")
    best = values.groupBy(*KEYS, "k").agg(F.min_by("v", F.struct("rank", "seq")).alias("v"))
    return best.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("parameters"))


def merged(findings: DataFrame) -> DataFrame:
    """One row for each asset of a run. Ties go to the lowest seq; the result doesn't depend on the order of the rows.

    Nulls in target, kind or name are values of their own; an asset without evidence has confidence 0. locations has every distinct
    location in words, by surface and words; n_locations counts those that differ in surface or words.
    """
    rows = keyed(findings)
    place = identity.describe(F.col("location"))
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("seq")))
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("sightings"),
        F.min_by(F.struct("target_id", "asset_kind", "name", "primitive", place.alias("place")), F.struct("rank", place.alias("place"), "seq")).alias("p"),
        sets("location.surface").alias("surfaces"), sets("collector").alias("collectors"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("functions")))), ",").alias("functions"),
        first("library").alias("library"), first("oid").alias("oid"), F.max("observed_at").alias("last_observed"),
    )
    alike = rows.filter("location IS NOT NULL").select(*KEYS, "location", "location.surface", place.alias("place")).groupBy(*KEYS, "surface", "place").agg(F.count_distinct("location").cast("int").alias("n"))
    every = F.array_sort(F.collect_list(F.struct(F.coalesce("surface", F.lit("")).alias("surface"), "place", "n")))
    spots = alike.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_locations"), F.flatten(F.transform(every, lambda s: F.array_repeat(s["place"], s["n"]))).alias("locations"))
    out = base.join(confidence(rows), KEYS, "left").join(spots, KEYS, "left").join(merged_parameters(rows), KEYS, "left")
    return out.select(
        *KEYS, "p.target_id", "p.asset_kind", "p.name", "p.primitive", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "sightings", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
        F.coalesce("n_locations", F.lit(0)).alias("n_locations"), F.coalesce("tiers", F.lit("")).alias("tiers"), "surfaces", "collectors", "functions", "library", "oid", F.col("p.place").alias("primary_location"),
        F.contains("surfaces", F.lit(",")).alias("corroborated"), "last_observed", F.coalesce("parameters", F.create_map().cast("map<string,string>")).alias("parameters"),
        F.coalesce("locations", F.array().cast("array<string>")).alias("locations"), F.coalesce("matchers", F.lit("")).alias("matchers"),
    )


def reach(assets: DataFrame) -> DataFrame:
    """run_id, name, targets: in how many targets each name is. The pairs are made distinct first, so a hot name is no hot task."""
    return assets.select("run_id", "name", "target_id").distinct().groupBy("run_id", "name").agg(F.count("target_id").alias("targets"))
