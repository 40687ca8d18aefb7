"""Confidence of assets kept up to date over a stream of sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators import assets


def running_confidence(sightings: DataFrame, lateness: str = "30 days") -> DataFrame:
    """run_id, asset_ref, confidence, n_evidence: over a stream; a witness is counted once, state is dropped lateness after it was seen.

    Noisy-or depends only on how many distinct witnesses each tier has, so the state is those numbers.
    """
    rows = assets.keyed(sightings.withWatermark("observed_at", lateness))
    seen = rows.select(*assets.KEYS, "observed_at", F.explode("evidence").alias("e")).filter(F.col("e.tier").isin(*dims.TIERS))
    once = seen.select(*assets.KEYS, "observed_at", "e.tier", "e.matcher_id", "e.snippet").dropDuplicatesWithinWatermark([*assets.KEYS, "tier", "matcher_id", "snippet"])
    counts = once.groupBy(*assets.KEYS).agg(F.count(F.lit(1)).alias("n_evidence"), *[F.count_if(F.col("tier") == t).alias(t) for t in dims.TIERS])
    return counts.select(*assets.KEYS, assets.noisy_or({t: F.col(t) for t in dims.TIERS}).alias("confidence"), "n_evidence")


def arrivals(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """window_start, event_type, n: tumbling counts with a watermark, over a stream or a table with ts and event_type."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n")
