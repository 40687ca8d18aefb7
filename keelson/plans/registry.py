"""Queries of the core, by name, with the SQL each must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators import hotkeys, snapshots
from keelson.plans import analysis, inventory
from keelson.sources import table
from keelson.streaming import confidence

Query = Callable[[SparkSession, str], DataFrame]

ASSET = ("run_id", "bom_ref")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.hot_keys(table(spark, d, "findings"), ["name", "target_id"])


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_counts(table(spark, d, "findings"), ["name", "target_id"])


def p3_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_totals(table(spark, d, "findings"), ["name", "target_id"], ASSET, "observed_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "components")).select("snapshot_no", "bom_ref", "change_kind")


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    c = snapshots.snapshot_changes(table(spark, d, "components"))
    return c.select("snapshot_no", "bom_ref", "change_kind", F.explode("changes").alias("c")).select("snapshot_no", "bom_ref", "change_kind", F.col("c.key").alias("property"), F.col("c.before").alias("before_value"), F.col("c.after").alias("after_value"))


def str_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return confidence.arrivals(table(spark, d, "events"))


QUERIES: dict[str, Query] = {"str_arrivals": str_arrivals, "p3_found": p3_found, "p3_counts": p3_counts, "p3_key_totals": p3_key_totals, "p5_found": p5_found, "p5_changes": p5_changes, **inventory.QUERIES, **analysis.QUERIES}

_KEYED = """SELECT 'name' AS field, name AS key_value, run_id, bom_ref, observed_at FROM findings WHERE name IS NOT NULL
UNION ALL SELECT 'target_id', target_id, run_id, bom_ref, observed_at FROM findings WHERE target_id IS NOT NULL"""

_WORD = "nullif(lower(regexp_replace(p['" + dims.PREFIX + "{0}'], '^\\s+|\\s+$', '', 'g')), '')"
_SET = "nullif(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(" + _WORD + ", '[,;|/\\s]+'), lambda x: x <> ''))), ','), '')"
_SNAPSHOTS = f"""WITH r AS (SELECT snapshot_no, delivered_at, regexp_replace(lower(trim(bom_ref)), '^urn:cbom:', '') AS bom_ref, properties AS p FROM components),
v AS (SELECT snapshot_no, bom_ref, delivered_at, coalesce(round(try_cast({_WORD.format("confidence")} AS DOUBLE), 9)::VARCHAR, {_WORD.format("confidence")}) AS confidence,
 {_SET.format("surfaces")} AS surfaces, {_SET.format("collectors")} AS collectors, {_WORD.format("quantum-status")} AS quantum_status,
 {_WORD.format("classical-status")} AS classical_status, {_WORD.format("corroborated")} AS corroborated
 FROM r WHERE regexp_full_match(bom_ref, '[0-9a-f]{{16}}')),
w AS (SELECT * EXCLUDE (rn, delivered_at) FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, bom_ref ORDER BY delivered_at DESC NULLS LAST, confidence DESC NULLS LAST, surfaces DESC NULLS LAST,
 collectors DESC NULLS LAST, quantum_status DESC NULLS LAST, classical_status DESC NULLS LAST, corroborated DESC NULLS LAST) AS rn FROM v) WHERE rn = 1),
n AS (SELECT * FROM w WHERE snapshot_no IN (SELECT snapshot_no + 1 FROM w)),
o AS (SELECT * REPLACE (snapshot_no + 1 AS snapshot_no) FROM w WHERE snapshot_no + 1 IN (SELECT snapshot_no FROM w)),
j AS (SELECT coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.bom_ref, o.bom_ref) AS bom_ref,
 CASE WHEN o.bom_ref IS NULL THEN 'added' WHEN n.bom_ref IS NULL THEN 'removed' ELSE 'changed' END AS change_kind, n, o FROM n FULL JOIN o ON n.snapshot_no = o.snapshot_no AND n.bom_ref = o.bom_ref)
"""
_DIFFERS = " OR ".join(f"(n.{c} IS DISTINCT FROM o.{c})" for c in ("confidence", "surfaces", "collectors", "quantum_status", "classical_status", "corroborated"))

ORACLE: dict[str, str] = {
    **inventory.ORACLE,
    **analysis.ORACLE,
    "p3_found": f"SELECT field, key_value FROM ({_KEYED}) GROUP BY ALL HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM findings)",
    "p3_counts": f"SELECT field, key_value, count(*) AS sightings FROM ({_KEYED}) GROUP BY field, key_value",
    "p3_key_totals": f"SELECT field, key_value, count(*) AS sightings, count(DISTINCT (run_id, bom_ref)) FILTER (WHERE bom_ref IS NOT NULL) AS assets, max(observed_at) AS latest FROM ({_KEYED}) GROUP BY field, key_value",
    "p5_found": f"{_SNAPSHOTS} SELECT snapshot_no, bom_ref, change_kind FROM j WHERE change_kind <> 'changed' OR {_DIFFERS}",
    "p5_changes": f"{_SNAPSHOTS} " + " UNION ALL ".join(f"SELECT snapshot_no, bom_ref, change_kind, '{c.replace('_', '-')}' AS property, o.{c} AS before_value, n.{c} AS after_value FROM j WHERE n.{c} IS DISTINCT FROM o.{c}" for c in ("confidence", "surfaces", "collectors", "quantum_status", "classical_status", "corroborated")),
}
ORACLE["agg_property_changes"] = f"SELECT snapshot_no, change_kind, count(*) AS assets FROM ({ORACLE['p5_found']}) GROUP BY ALL"
ORACLE["str_arrivals"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
