"""More of the inventory's queries: views, orders, evidence, recommendations in full, typed properties, detection; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators import assets, canonical, detection, identity, inventory, risk, sightings
from keelson.plans import inventory as inv
from keelson.plans import outputs
from keelson.sources import journal, table

KEYS = assets.KEYS


def flt_libraries(spark: SparkSession, d: str) -> DataFrame:
    return inv._merged(spark, d).filter("asset_kind = 'library'").select(*KEYS, "name")


def flt_urgent(spark: SparkSession, d: str) -> DataFrame:
    return inv._assessed(spark, d).filter(F.col("tier").isin("critical", "high")).select(*KEYS, "tier")


def flt_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """The queue as a user narrows it: one tier, one surface, a word in name, target or recommendation."""
    q = inv._queue(spark, d).filter((F.col("tier") == "critical") & F.array_contains(F.split("surfaces", ","), "source"))
    return q.filter(F.contains(F.lower(F.concat_ws(" ", "name", "target_id", "recommended")), F.lit("rsa"))).select(*KEYS, "name", "target_id", "recommended")


def agg_tier_share(spark: SparkSession, d: str) -> DataFrame:
    n = inv.agg_tier_summary(spark, d)
    return n.crossJoin(n.agg(F.greatest(F.sum("assets"), F.lit(1)).alias("total"))).select("tier", (F.col("assets") * 100.0 / F.col("total")).alias("percent"))  # one row


def srt_assets(spark: SparkSession, d: str) -> DataFrame:
    return inv._merged(spark, d).select(*KEYS, "confidence").orderBy(F.col("confidence").desc(), "asset_ref", "run_id")


def srt_assessments(spark: SparkSession, d: str) -> DataFrame:
    a = inv._assessed(spark, d).select(*KEYS, "tier", "confidence", dims.lookup(dims.RISK_ORDER, F.col("tier")).alias("tier_order"))
    return a.orderBy("tier_order", F.col("confidence").desc(), "asset_ref", "run_id")


def lim_urgent40(spark: SparkSession, d: str) -> DataFrame:
    return risk.ordered(inv._queue(spark, d).filter(F.col("tier").isin("critical", "high")).select(*inv.QUEUE)).limit(40).select(*KEYS, "tier", "name")


def lim_locations(spark: SparkSession, d: str) -> DataFrame:
    m = inv._merged(spark, d)
    return m.select(*KEYS, F.array_join(F.slice("locations", 1, 5), " | ").alias("shown"), F.greatest(F.size("locations") - 5, F.lit(0)).alias("omitted"))


def agg_locations(spark: SparkSession, d: str) -> DataFrame:
    return inv._merged(spark, d).select(*KEYS, F.posexplode("locations").alias("n", "place"))


def agg_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of each asset in order: of the same tier, matcher and snippet the first record."""
    e = assets.keyed(table(spark, d, "findings")).select(*KEYS, "seq", F.explode("evidence").alias("e")).filter("e IS NOT NULL")
    first = e.groupBy(*KEYS, "e.tier", "e.matcher_id", "e.snippet").agg(F.min("seq").alias("seq"))
    rank = F.coalesce(dims.lookup(assets._RANKS, F.col("tier")), F.lit(len(assets._RANKS)))
    w = Window.partitionBy(*KEYS).orderBy(rank, F.col("matcher_id").asc_nulls_first(), "seq", F.col("tier").asc_nulls_first(), F.col("snippet").asc_nulls_first())
    return first.withColumn("n", F.row_number().over(w) - 1)


def jn_recommend_detail(spark: SparkSession, d: str) -> DataFrame:
    q = risk.detailed(inv._queue(spark, d)).filter("recommended IS NOT NULL")
    words = F.array_join(F.transform("deltas", risk.described), "; ")
    return q.select(*KEYS, "recommended", "standard", "hybrid", "alternative", "rationale", "latency_note", words.alias("deltas"))


def lim_headline(spark: SparkSession, d: str) -> DataFrame:
    # exploded, not filtered: a filter would be pushed down with all that headline is made of
    q = risk.detailed(inv._queue(spark, d)).select(*KEYS, F.explode(F.array_compact(F.array("headline"))).alias("h"))
    return q.select(*KEYS, "h.field", "h.delta", "h.ratio")


def fn_tier_reason(spark: SparkSession, d: str) -> DataFrame:
    return inv._assessed(spark, d).select(*KEYS, risk.reason().alias("reason"))


def set_collected(spark: SparkSession, d: str) -> DataFrame:
    """What collectors gave, sightings and errors, as one relation."""
    f = table(spark, d, "findings").select("target_id", "collector", F.lit("finding").alias("outcome"), F.col("name").alias("what"))
    e = table(spark, d, "errors").select("target_id", "collector", F.lit("error").alias("outcome"), F.col("reason").alias("what"))
    return f.unionByName(e)


def flt_unknown_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets that no collector takes, as error rows; none is dropped."""
    t = table(spark, d, "targets").filter("kind = 'unknown' OR kind IS NULL")
    return t.select("target_id", F.lit("scan").alias("collector"), F.lit("classify").alias("phase"), F.lit("not a path or an endpoint").alias("reason"))


def flt_should_scan(spark: SparkSession, d: str) -> DataFrame:
    """Targets with files that no complete row of the manifest has with the same content."""
    now = journal.content_hashes(table(spark, d, "source_files").filter("target_id IS NOT NULL"))
    done = journal.manifest(now, table(spark, d, "findings"), table(spark, d, "errors"))
    return journal.to_scan(now, done).select("target_id")


def agg_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return journal.content_hashes(table(spark, d, "source_files"))


def fn_snippets(spark: SparkSession, d: str) -> DataFrame:
    s = F.regexp_replace("e.snippet", r"^\s+|\s+$", "")
    return table(spark, d, "findings").select("seq", F.posexplode("evidence").alias("n", "e")).select("seq", "n", F.substring(s, 1, 120).alias("short"), F.substring(s, 1, 160).alias("long"))


def fn_functions(spark: SparkSession, d: str) -> DataFrame:
    known = F.array_sort(F.array_distinct(F.filter("functions", lambda f: f.isin(*sightings.FUNCTIONS))))
    return table(spark, d, "findings").select("seq", F.array_join(known, ",").alias("functions"))


def fn_shorten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").select("seq", outputs.shorten(F.col("location.path")).alias("path"))


def cbom_crypto(spark: SparkSession, d: str) -> DataFrame:
    return inventory.crypto_properties(inv._merged(spark, d))


def jn_registry_family(spark: SparkSession, d: str) -> DataFrame:
    """Families by an operator's registry, of the tables algorithms and aliases, instead of the one that is built in."""
    registry = canonical.registry(table(spark, d, "algorithms"), table(spark, d, "aliases"))
    return canonical.resolved(table(spark, d, "findings").select("seq", "name"), registry).select("seq", "registry_family")


def det_findings(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of the source files by the call rules, those of source_rules among them."""
    f = sightings.from_sources(table(spark, d, "source_files"), sightings.rules(spark, table(spark, d, "source_rules")))
    e = F.get("evidence", F.lit(0))
    return f.select("target_id", "asset_kind", "name", "primitive", F.to_json("parameters").alias("parameters"), F.array_join("functions", ",").alias("functions"), "library", "confidence", "location.path", "location.line", e["tier"].alias("tier"), e["matcher_id"].alias("matcher_id"), e["snippet"].alias("snippet"))


def det_source_errors(spark: SparkSession, d: str) -> DataFrame:
    return sightings.source_errors(table(spark, d, "source_files"))


def det_handshakes(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of handshakes, which protocol rows of the findings state: the protocol's own and its suite's."""
    p = lambda k: F.try_element_at("parameters", F.lit(k))
    h = table(spark, d, "findings").filter("asset_kind = 'protocol'").select("seq", "target_id", F.col("location.endpoint").alias("endpoint"), F.concat(F.lit("TLSv"), p("version")).alias("version"), p("cipher_suite").alias("suite"))
    f = sightings.from_handshakes(h)
    return f.groupBy("target_id", "asset_kind", "name", "confidence").agg(F.count(F.lit(1)).alias("sightings"))


_HERE = dict(globals())
QUERIES = {n: f for n, f in _HERE.items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_"}

# ---------------------------------------------------------------- the same in SQL


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_DETAIL = {i: {k: v[i] for k, v in dims.REPLACEMENT_DETAILS.items() if v[i] is not None} for i in range(4)}
_ENTRIES = {f"{f}|{r}": f"{f}|{r}" for f, e in dims.REPLACEMENTS.items() for r in e}
_FIRST = {f: f"{f}|{next(iter(e))}" for f, e in dims.REPLACEMENTS.items()}
_SIZES = ", ".join(f"{dims.sql_lookup(dims.size_table(i), inv._sq('canonical_name'))} AS a_{f}, {dims.sql_lookup(dims.size_table(i), inv._sq('recommended'))} AS b_{f}" for i, f in enumerate(dims.SIZE_FIELDS))
_RATIO = "CASE WHEN a_{0} > 0 THEN round(b_{0} / a_{0}, 1) END"
_WORDS = ", ".join(
    f"CASE WHEN a_{f} IS NOT NULL AND b_{f} IS NOT NULL THEN '{f} ' || a_{f} || ' B -> ' || b_{f} || ' B' || CASE WHEN a_{f} > 0 THEN ' (' || CASE WHEN b_{f} >= a_{f} THEN '+' ELSE '' END || (b_{f} - a_{f}) || ' B, ' || printf('%.1f', {_RATIO.format(f)}) || 'x)' ELSE '' END END" for f in dims.SIZE_FIELDS
)
_D = f"""{inv._Q}, d AS (SELECT *, {_SIZES}, coalesce(list_filter(list_transform(flatten(list_transform(string_split(functions, ','), lambda f: string_split(coalesce({dims.sql_lookup(inv._ROLE, "f")}, ''), ','))), lambda r: {dims.sql_lookup(_ENTRIES, "family || '|' || r")}), lambda t: t IS NOT NULL)[1],
 {dims.sql_lookup(_FIRST, "family")}) AS entry FROM q WHERE recommended IS NOT NULL)"""
_HEAD = ["signature", "ciphertext", "public_key", "private_key"]
_BOTH = "a_{0} IS NOT NULL AND b_{0} IS NOT NULL"
_N = len(dims.SCENARIOS)


def _word(k: str, words) -> str:
    return f"CASE WHEN lower(parameters['{k}']) IN {_list(words)} THEN lower(parameters['{k}']) END"


_CN = f"{inv._MP}, {inv._canon('ma')}"
_LA = f"WITH {inv._M}, {inv._WHOLE}"
_PROTOCOL = "upper(coalesce(nullif(parameters['protocol'], ''), name))"

ORACLE = {
    "flt_libraries": f"WITH {inv._M} SELECT run_id, asset_ref, name FROM m WHERE asset_kind = 'library'",
    "flt_urgent": f"WITH {inv._A} SELECT run_id, asset_ref, tier FROM a WHERE tier IN ('critical', 'high')",
    "flt_dashboard": f"WITH {inv._Q} SELECT run_id, asset_ref, name, target_id, recommended FROM q WHERE tier = 'critical' AND list_contains(string_split(surfaces, ','), 'source') AND contains(lower(concat_ws(' ', name, target_id, recommended)), 'rsa')",
    "agg_tier_share": f"WITH x AS ({inv.ORACLE['agg_tier_summary']}) SELECT tier, assets * 100.0::DOUBLE / (SELECT greatest(sum(assets), 1) FROM x) AS percent FROM x",
    "srt_assets": f"WITH {inv._M} SELECT run_id, asset_ref, confidence FROM m ORDER BY confidence DESC, asset_ref, run_id",
    "srt_assessments": f"WITH {inv._A} SELECT run_id, asset_ref, tier, confidence, {dims.sql_lookup(dims.RISK_ORDER, 'tier')} AS tier_order FROM a ORDER BY tier_order, confidence DESC, asset_ref, run_id",
    "lim_urgent40": f"WITH {inv._Q} SELECT run_id, asset_ref, tier, name FROM q WHERE tier IN ('critical', 'high') {inv._ORDER} LIMIT 40",
    "lim_locations": f"{_LA} SELECT m.run_id, m.asset_ref, coalesce(string_agg(place, ' | ' ORDER BY n) FILTER (WHERE n < 5), '') AS shown, CAST(greatest(count(n) - 5, 0) AS INT) AS omitted FROM m LEFT JOIN l ON m.run_id IS NOT DISTINCT FROM l.run_id AND m.asset_ref = l.asset_ref GROUP BY ALL",
    "agg_locations": f"{_LA} SELECT run_id, asset_ref, CAST(n AS INT) AS n, place FROM l",
    "agg_evidence": f"""WITH {inv._K}, x AS (SELECT run_id, asset_ref, seq, unnest(evidence) AS e FROM k), f AS (SELECT run_id, asset_ref, e.tier AS tier, e.matcher_id AS matcher_id, e.snippet AS snippet, min(seq) AS seq FROM x WHERE e IS NOT NULL GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY run_id, asset_ref ORDER BY coalesce({dims.sql_lookup({t: i for i, t in enumerate(dims.TIERS)}, 'tier')}, {len(dims.TIERS)}), matcher_id NULLS FIRST, seq, tier NULLS FIRST, snippet NULLS FIRST) - 1 AS INT) AS n FROM f""",
    "jn_recommend_detail": f"WITH {_D} SELECT run_id, asset_ref, recommended, {', '.join(f'{dims.sql_lookup(_DETAIL[i], "entry")} AS {c}' for i, c in enumerate(('standard', 'hybrid', 'alternative', 'rationale')))}, {dims.sql_lookup(dims.LATENCY, 'recommended')} AS latency_note, array_to_string(list_filter([{_WORDS}], lambda w: w IS NOT NULL), '; ') AS deltas FROM d",
    "lim_headline": f"WITH {_D}, h AS (SELECT run_id, asset_ref, CASE {' '.join(f"WHEN {_BOTH.format(f)} THEN '{f}'" for f in _HEAD)} END AS field, CAST(CASE {' '.join(f'WHEN {_BOTH.format(f)} THEN b_{f} - a_{f}' for f in _HEAD)} END AS INT) AS delta, CASE {' '.join(f'WHEN {_BOTH.format(f)} THEN {_RATIO.format(f)}' for f in _HEAD)} END AS ratio FROM d) SELECT * FROM h WHERE field IS NOT NULL",
    "fn_tier_reason": f"""WITH {inv._A} SELECT run_id, asset_ref, CASE WHEN classical_status IN ('broken', 'disallowed') THEN coalesce({dims.sql_lookup(dims.CLASSICAL_NOTES, 'family')}, 'Already unsound under classical cryptanalysis.')
 WHEN quantum_status = 'unknown' THEN 'Algorithm not in the registry; classify manually before dismissing.' WHEN quantum_status = 'safe' THEN 'Not quantum-vulnerable at current understanding.' WHEN tripped IS NULL THEN 'Quantum-vulnerable but no migration window computed.'
 WHEN tripped = {_N} THEN 'Mosca''s inequality trips under all {_N} scenarios (X=' || effort || 'y + Y=' || shelf_life || 'y).' WHEN contains(trips, 'median') THEN 'Mosca''s inequality trips under the median scenario (' || tripped || ' of {_N}).'
 WHEN tripped > 0 THEN 'Mosca''s inequality trips only under the pessimistic scenario (' || tripped || ' of {_N}).' WHEN quantum_status = 'weakened' THEN 'Grover halves the effective key length but the margin still holds.' ELSE 'Quantum-vulnerable but the migration window is not yet closing.' END AS reason FROM a""",
    "set_collected": "SELECT target_id, collector, 'finding' AS outcome, name AS what FROM findings UNION ALL SELECT target_id, collector, 'error', reason FROM errors",
    "flt_unknown_targets": "SELECT target_id, 'scan' AS collector, 'classify' AS phase, 'not a path or an endpoint' AS reason FROM targets WHERE kind = 'unknown' OR kind IS NULL",
    "flt_should_scan": "SELECT DISTINCT target_id FROM source_files WHERE target_id IN (SELECT target_id FROM errors WHERE target_id IS NOT NULL)",
    "agg_content_hash": """WITH one AS (SELECT target_id, sha256(concat_ws(chr(10), path, sha256(coalesce(content, ''::BLOB)))) AS h FROM source_files), b AS (SELECT target_id, left(h, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM one GROUP BY ALL)
SELECT target_id, sha256(string_agg(h, '' ORDER BY b)) AS content_hash FROM b GROUP BY target_id""",
    "fn_snippets": "WITH x AS (SELECT seq, unnest(range(len(evidence))) AS n, unnest(evidence) AS e FROM findings), s AS (SELECT seq, CAST(n AS INT) AS n, regexp_replace(e.snippet, '^\\s+|\\s+$', '', 'g') AS s FROM x) SELECT seq, n, left(s, 120) AS short, left(s, 160) AS long FROM s",
    "fn_functions": f"SELECT seq, array_to_string(list_sort(list_distinct(list_filter(functions, lambda f: f IN {_list(sightings.FUNCTIONS)}))), ',') AS functions FROM findings",
    "fn_shorten": "SELECT seq, CASE WHEN length(location.path) > 44 THEN '...' || right(location.path, 41) ELSE location.path END AS path FROM findings",
    "cbom_crypto": f"""WITH {_CN}, cx AS (SELECT *, asset_kind = 'algorithm' AS alg, asset_kind = 'protocol' AS pro, asset_kind = 'related-crypto-material' AS mat FROM cn) SELECT run_id, asset_ref AS bom_ref, asset_kind AS asset_type, CASE WHEN alg AND lower(primitive) IN {_list(inventory.PRIMITIVES)} THEN lower(primitive) END AS primitive,
 CASE WHEN alg THEN parameters['key_size'] END AS parameter_set, CASE WHEN alg THEN parameters['curve'] END AS curve, CASE WHEN alg THEN {_word('mode', inventory.MODES)} END AS mode, CASE WHEN alg THEN {_word('padding', inventory.PADDINGS)} END AS padding,
 CASE WHEN alg THEN array_to_string(list_filter(string_split(functions, ','), lambda f: f IN {_list(inventory.FUNCTIONS)}), ',') END AS crypto_functions, CASE WHEN alg THEN security_bits END AS classical_level, CASE WHEN alg THEN nist_level END AS nist_level,
 CASE WHEN pro THEN CASE {' '.join(f"WHEN starts_with({_PROTOCOL}, '{p}') THEN '{p.lower()}'" for p in inventory.PROTOCOLS)} ELSE 'other' END END AS protocol_type, CASE WHEN pro THEN coalesce(parameters['version'], '') END AS protocol_version,
 CASE WHEN mat THEN coalesce({_word('material_type', inventory.MATERIALS)}, 'key') END AS material_type, CASE WHEN mat THEN try_cast(parameters['key_size'] AS INT) END AS material_size, oid FROM cx""",
    "jn_registry_family": f"""WITH r AS (SELECT {inv._sq('family')} AS k, family, 0 AS o FROM algorithms WHERE entry_kind = 'algorithm' UNION ALL SELECT {inv._sq('name')}, family, 1 FROM algorithms WHERE entry_kind = 'algorithm'
 UNION ALL SELECT {inv._sq('alias')}, e.family, 2 FROM aliases a JOIN (SELECT DISTINCT family, unnest([family, name]) AS c FROM algorithms WHERE entry_kind = 'algorithm') e ON a.entry_kind = 'algorithm' AND a.canonical = e.c),
u AS (SELECT k, arg_min(family, (o, family)) AS family FROM r WHERE k <> '' GROUP BY k) SELECT seq, u.family AS registry_family FROM findings f LEFT JOIN u ON {inv._sq('f.name')} = u.k""",
    "det_source_errors": f"SELECT target_id, 'source_ast' AS collector, 'read' AS phase, CASE WHEN content IS NULL THEN 'no content' ELSE 'larger than {detection.SOURCE_CAP} bytes' END AS reason, path FROM source_files WHERE {dims.sql_lookup(detection.SUFFIXES, inv._SUFFIX)} IS NOT NULL AND (content IS NULL OR octet_length(content) > {detection.SOURCE_CAP})",
}
