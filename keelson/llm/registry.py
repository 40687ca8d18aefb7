"""Queries of this subpackage, by name, with the SQL each must equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import packing, sentences, spellings, survivors, syntax, tokens
from keelson.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.found(table(spark, d, "findings"), table(spark, d, "evidence_tiers"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return survivors.records(table(spark, d, "findings"), table(spark, d, "evidence_tiers"))


def _typed(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("findings", "source_rules", "algorithms", "aliases")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.mapped(spark, *_typed(spark, d))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return spellings.unmatched_values(spark, *_typed(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rejected(table(spark, d, "source_files"))


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return syntax.verdicts(table(spark, d, "source_files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "source_files"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "capacities"))


def p7_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.batches(table(spark, d, "documents"), table(spark, d, "capacities"))


def p7_batch_items(spark: SparkSession, d: str) -> DataFrame:
    return packing.batched(table(spark, d, "documents"), table(spark, d, "capacities"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p2_found": p2_found, "p2_unmatched": p2_unmatched, "p4_found": p4_found, "p4_flags": p4_flags, "p4_rates": p4_rates, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_batches": p7_batches, "p7_batch_items": p7_batch_items, "p8_found": p8_found}

_STANDINS = "('', 'unknown', '<unknown>', 'n/a', 'null', 'nil', 'none', 'undefined', 'not available', '(not set)', '-', '--', '?', '?:?', ':0', 'tbd', 'todo')"
_REAL = "(lower(trim({0}, ' ' || chr(9))) NOT IN " + _STANDINS + " AND {0} IS NOT NULL)"

ORACLE = {
    "p1_found": f"""WITH a AS (SELECT *, coalesce((SELECT max(t.strength) FROM (SELECT unnest(evidence) AS e) x JOIN evidence_tiers t ON t.tier = x.e.tier WHERE {_REAL.format("x.e.matcher_id")}), 0) AS best,
 len(list_filter(map_values(parameters), lambda v: {_REAL.format("v")})) AS stated, count(*) OVER (PARTITION BY run_id, bom_ref) AS n FROM findings WHERE bom_ref IS NOT NULL),
c AS (SELECT run_id, bom_ref, 'locations' AS field, seq, 0 AS first, best, observed_at FROM a WHERE n > 1 AND ({_REAL.format("location.path")} OR {_REAL.format("location.endpoint")})
 UNION ALL SELECT run_id, bom_ref, 'evidence', seq, 0, best, observed_at FROM a WHERE n > 1 AND best > 0
 UNION ALL SELECT run_id, bom_ref, 'confidence', seq, 0, best, observed_at FROM a WHERE n > 1 AND confidence > 0 AND confidence <= 1
 UNION ALL SELECT run_id, bom_ref, 'parameters', seq, stated, best, observed_at FROM a WHERE n > 1 AND stated > 0)
SELECT run_id, bom_ref, field, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id, bom_ref, field ORDER BY first DESC, best DESC, observed_at DESC, seq) AS rn FROM c) WHERE rn = 1""",
}
