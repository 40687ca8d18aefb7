"""The inventory's queries over the project's tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators import assets, canonical, detection, identity, inventory, risk, snapshots
from keelson.sources import table

KEYS = assets.KEYS
ASSESSED = ["family", "canonical_name", "effort", "shelf_life", "quantum_status", "classical_status", "trips", "tripped", "milestones", "tier"]


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return assets.merged(table(spark, d, "findings"))


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    return risk.assessed(_merged(spark, d), table(spark, d, "targets"))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return risk.queue(_assessed(spark, d), assets.reach(table(spark, d, "findings").filter("asset_kind <> 'library'")))


QUEUE = [*KEYS, "target_id", "name", "tier", "tier_order", "targets", "recommended", "cost_bytes"]


def prj_bom_ref(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("target_id", "asset_kind", "name", "parameters")]
    return table(spark, d, "findings").select("seq", identity.canonical_key(*c).alias("canonical_key"), identity.bom_ref(*c).alias("asset_ref"))


def prj_location(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").select("seq", identity.describe(F.col("location")).alias("place"))


def jn_resolve_family(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonicalised_once(table(spark, d, "findings").select("seq", "name", F.create_map().cast("map<string,string>").alias("parameters"))).select("seq", "family")


CANONICAL = ["family", "parameter", "canonical_name", "security_bits", "quantum_bits", "quantum_status", "classical_status", "oid_registered", "nist_level", "standard"]


def fn_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonicalised_once(table(spark, d, "findings").select("seq", "name", "parameters")).select("seq", *CANONICAL)


def agg_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return assets.confidence(assets.keyed(table(spark, d, "findings"))).drop("matchers")


def agg_parameters(spark: SparkSession, d: str) -> DataFrame:
    return assets.merged_parameters(assets.keyed(table(spark, d, "findings"))).select(*KEYS, F.explode("parameters").alias("parameter", "value"))


def agg_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).drop("parameters", "locations", "matchers")


def agg_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return assets.reach(_merged(spark, d))


def fn_risk_tier(spark: SparkSession, d: str) -> DataFrame:
    return _assessed(spark, d).select(*KEYS, *ASSESSED)


def jn_mosca(spark: SparkSession, d: str) -> DataFrame:
    a = _assessed(spark, d).filter(F.col("quantum_status").isin("broken", "weakened"))
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(z).alias("years")) for n, z in dims.SCENARIOS.items()])).alias("s")
    total = F.col("effort") + F.col("shelf_life")
    return a.select(*KEYS, "effort", "shelf_life", s).select(*KEYS, "s.scenario", (F.col("s.years") - total).alias("margin_years"), (total > F.col("s.years")).alias("trips"))


def jn_deadlines(spark: SparkSession, d: str) -> DataFrame:
    years = {i: y for i, y, _ in dims.MILESTONES}
    a = _assessed(spark, d).select(*KEYS, F.explode(F.split("milestones", ",")).alias("milestone"))
    return a.withColumn("years_remaining", dims.lookup(years, F.col("milestone")) - dims.REFERENCE_YEAR)


def agg_tier_summary(spark: SparkSession, d: str) -> DataFrame:
    tiers = spark.createDataFrame([(t,) for t in dims.RISK_ORDER], "tier string")
    n = _assessed(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return tiers.join(n, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("assets"))


def jn_recommend(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d).select(*KEYS, "recommended", *[F.col(f"delta_{f}").cast("bigint").alias(f"delta_{f}") for f in dims.SIZE_FIELDS], "cost_bytes")


def srt_queue(spark: SparkSession, d: str) -> DataFrame:
    return risk.ordered(_queue(spark, d).select(*QUEUE))


def win_queue_rank(spark: SparkSession, d: str) -> DataFrame:
    return risk.ranked(_queue(spark, d).select(*QUEUE)).select("rank", *KEYS)


def lim_top40(spark: SparkSession, d: str) -> DataFrame:
    return risk.ordered(_queue(spark, d).select(*QUEUE)).limit(40)


def agg_cost_summary(spark: SparkSession, d: str) -> DataFrame:
    """By what is recommended; the row without a name has the totals."""
    q = _queue(spark, d).filter("recommended IS NOT NULL")
    return q.rollup("recommended").agg(F.count(F.lit(1)).alias("actionable"), F.coalesce(F.sum("cost_bytes"), F.lit(0)).alias("cost_bytes"))


def flt_confidence_floor(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).filter(F.col("confidence") >= dims.FLOOR).select(*KEYS, "confidence")


def _bags(components: DataFrame) -> DataFrame:
    return components.select("run_id", "bom_ref", "type", "name", F.explode("properties").alias("p")).select("run_id", "bom_ref", "type", "name", F.col("p.name").alias("property"), F.col("p.value").alias("value"))


def cbom_properties(spark: SparkSession, d: str) -> DataFrame:
    return _bags(inventory.components(_merged(spark, d), brief=True))


def cbom_bag(spark: SparkSession, d: str) -> DataFrame:
    return _bags(inventory.components(_merged(spark, d)))


def cbom_serial(spark: SparkSession, d: str) -> DataFrame:
    return inventory.serial(inventory.components(_merged(spark, d)))


def set_common(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "components").select("snapshot_no", snapshots.plain_ref(F.col("bom_ref")).alias("bom_ref")).filter("bom_ref IS NOT NULL")
    return refs.intersect(refs.select((F.col("snapshot_no") + 1).alias("snapshot_no"), "bom_ref"))


def agg_property_changes(spark: SparkSession, d: str) -> DataFrame:
    c = snapshots.snapshot_changes(table(spark, d, "components"))
    return c.groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("assets"))


def agg_run_counters(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").groupBy("target_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("asset_kind") == "library").alias("libraries"))
    e = table(spark, d, "errors").groupBy("target_id").agg(F.count(F.lit(1)).alias("errors"))
    j = f.withColumnRenamed("target_id", "a").join(e.withColumnRenamed("target_id", "b"), F.col("a").eqNullSafe(F.col("b")), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(F.coalesce("a", "b").alias("target_id"), zero("findings"), zero("libraries"), zero("errors"), F.when(F.coalesce("errors", F.lit(0)) > 0, "error").otherwise("complete").alias("status"))


def flt_resume_skip(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "errors").select("target_id").distinct()
    return table(spark, d, "targets").join(done, "target_id", "left_anti").select("target_id", "kind")


def jn_supports(spark: SparkSession, d: str) -> DataFrame:
    by_kind = {"directory": "source_ast,elf", "file": "source_ast,elf", "container": "container", "endpoint": "tls"}
    return table(spark, d, "targets").select("target_id", F.explode(F.split(dims.lookup(by_kind, F.col("kind")), ",")).alias("collector"))


def src_classify(spark: SparkSession, d: str) -> DataFrame:
    raw = F.coalesce(F.when(F.col("host").isNotNull() & F.col("port").isNotNull(), F.concat_ws(":", "host", "port")), F.col("path"))
    return table(spark, d, "targets").select("target_id", raw.alias("raw")).filter("raw IS NOT NULL").select("target_id", detection.target_kind(F.col("raw")).alias("kind_said"))


def det_calls(spark: SparkSession, d: str) -> DataFrame:
    return detection.calls(table(spark, d, "source_files"))


def det_includes(spark: SparkSession, d: str) -> DataFrame:
    return detection.includes(table(spark, d, "source_files")).select("file_id", "library")


def det_transformation(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "findings").filter("name IS NOT NULL").select("seq", detection.transformation(F.col("name")).alias("t"))
    return t.select("seq", "t.algorithm", "t.mode", "t.padding")


_SUITES = ["TLS_AES_256_GCM_SHA384", "TLS_AES_128_GCM_SHA256", "ECDHE-RSA-AES256-GCM-SHA384", "ECDHE-RSA-AES256-SHA384", "DHE-RSA-AES128-SHA", "DES-CBC3-SHA", "TLS_RSA_WITH_AES_128_CBC_SHA", "ECDHE-ECDSA-CHACHA20-POLY1305", "RC4-MD5", "none"]


def det_suites(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([(x,) for x in _SUITES], "suite string")
    return s.select("suite", F.posexplode(detection.suite_parts(F.col("suite"))).alias("place", "algorithm"))


def det_suite_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").select("seq", F.posexplode(detection.suite_parts(F.col("name"))).alias("place", "algorithm"))


_STATUS = "Package: openssl\r\nVersion: 3.0.2-0ubuntu1\r\nDescription: tool\r\n a: b\r\n\r\nPackage: coreutils\r\nVersion: 9.1\r\n\r\nPackage: libssl3\nVersion: 3:1.2\n\nP:libcrypto3\nV:3.1.4-r1\n\nPackage: openssl\nVersion: 3.0.2-0ubuntu1\n"


def src_packages(spark: SparkSession, d: str) -> DataFrame:
    return detection.packages(spark.createDataFrame([("image-1", _STATUS)], "target_id string, status string"), "status", ["target_id"])


def src_package_texts(spark: SparkSession, d: str) -> DataFrame:
    return detection.packages(table(spark, d, "documents"), "text", ["doc_id"])


def agg_surface_facet(spark: SparkSession, d: str) -> DataFrame:
    s = _queue(spark, d).select(F.explode(F.split("surfaces", ",")).alias("surface")).filter("surface <> ''")
    return s.groupBy("surface").agg(F.count(F.lit(1)).alias("assets"))


def lim_errors100(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "errors").orderBy(F.col("reported_at").desc(), "error_id").limit(100).select("error_id", "target_id", "phase", "reason")


_HERE = dict(globals())
QUERIES = {n: _HERE[n] for n in _HERE if n.split("_")[0] in ("prj", "jn", "fn", "agg", "srt", "win", "lim", "flt", "cbom", "set", "src", "det") and callable(_HERE[n])}

# ---------------------------------------------------------------- the same in SQL


def _js(x: str) -> str:
    q = f"('\"' || replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '\"')"
    return f"coalesce(CASE WHEN regexp_matches({q}, '[^\\x00-\\x7F]') THEN array_to_string(list_transform(string_split({q}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') END), '') ELSE {q} END, 'null')"


_PAIRS = ", ".join(f"CASE WHEN parameters['{k}'] IS NOT NULL THEN '[\"{k}\",' || {_js(f"parameters['{k}']")} || ']' END" for k in dims.SIGNIFICANT)
_KEY = f"'[' || {_js('target_id')} || ',' || {_js('asset_kind')} || ',' || {_js('name')} || ',[' || coalesce(array_to_string(list_filter([{_PAIRS}], lambda x: x IS NOT NULL), ','), '') || ']]'"
_PLACE = """CASE WHEN coalesce(location.endpoint, '') <> '' THEN location.endpoint ELSE coalesce(nullif(location.path, ''), '<unknown>') ||
 CASE WHEN location.line IS NOT NULL THEN ':' || location.line WHEN location.byte_offset IS NOT NULL THEN '@0x' || lower(to_hex(location.byte_offset)) ELSE '' END ||
 CASE WHEN coalesce(location.layer_digest, '') <> '' THEN ' (layer ' || substr(location.layer_digest, 1, 19) || ')' ELSE '' END END"""
_RANK = f"coalesce(list_min(list_transform(evidence, lambda e: coalesce({dims.sql_lookup({t: i for i, t in enumerate(dims.TIERS)}, 'e.tier')}, {len(dims.TIERS)}))), {len(dims.TIERS)})"
_TIERS = ", ".join(f"'{t}'" for t in dims.TIERS)
_K = f"k AS (SELECT *, substr(sha256({_KEY}), 1, 16) AS asset_ref, {_PLACE} AS place, {_RANK} AS rank FROM findings)"
_E = f"""e AS (SELECT DISTINCT run_id, asset_ref, x.e.tier AS tier, x.e.matcher_id AS matcher_id, x.e.snippet AS snippet FROM (SELECT run_id, asset_ref, unnest(evidence) AS e FROM k) x WHERE x.e.tier IN ({_TIERS})),
c AS (SELECT run_id, asset_ref, round(least(1 - {" * ".join(f"pow({round(1 - b, 2)}, count(*) FILTER (WHERE tier = '{t}'))" for t, b in dims.TIERS.items())}, {dims.CEILING}), 4) AS confidence, count(*) AS n_evidence,
 array_to_string(list_sort(list(DISTINCT tier)), ',') AS tiers FROM e GROUP BY ALL)"""
_V = """v AS (SELECT run_id, asset_ref, m.key AS parameter, arg_min(m.value, printf('%02d-%020d', rank, seq)) AS value FROM (SELECT run_id, asset_ref, rank, seq, unnest(map_entries(parameters)) AS m FROM k) WHERE m.value IS NOT NULL GROUP BY ALL)"""
_M = f"""{_K}, {_E}, b AS (SELECT run_id, asset_ref, count(*) AS sightings, coalesce(array_to_string(list_sort(list(DISTINCT location.surface) FILTER (WHERE location.surface IS NOT NULL)), ','), '') AS surfaces,
 array_to_string(list_sort(list(DISTINCT collector)), ',') AS collectors, coalesce(array_to_string(list_sort(list_distinct(flatten(list(functions)))), ','), '') AS functions,
 arg_min(library, seq) FILTER (WHERE library <> '') AS library, arg_min(oid, seq) FILTER (WHERE oid <> '') AS oid, max(observed_at) AS last_observed,
 count(DISTINCT coalesce(location.surface, '?') || '~' || place) FILTER (WHERE location IS NOT NULL) AS n_locations FROM k GROUP BY run_id, asset_ref),
p AS (SELECT run_id, asset_ref, target_id, asset_kind, name, primitive, place AS primary_location FROM k QUALIFY row_number() OVER (PARTITION BY run_id, asset_ref ORDER BY rank, place, seq) = 1),
m AS (SELECT run_id, asset_ref, target_id, asset_kind, name, primitive, coalesce(confidence, 0.0) AS confidence, sightings, coalesce(n_evidence, 0) AS n_evidence, n_locations, coalesce(tiers, '') AS tiers, surfaces, collectors, functions,
 library, oid, primary_location, contains(surfaces, ',') AS corroborated, last_observed FROM b JOIN p USING (run_id, asset_ref) LEFT JOIN c USING (run_id, asset_ref))"""


def _sq(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9+]', '', 'g')"


def _family(x: str) -> str:
    tokens = f"list_filter(regexp_split_to_array(lower({x}), '[-_/\\s.\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+'), lambda t: t <> '')"
    windows = f"flatten(list_transform(range(0, len({tokens})), lambda k: list_transform(range(0, k + 1), lambda s: {dims.sql_lookup(dims.BY_SQUASH, _sq(f"array_to_string(({tokens})[s + 1:s + len({tokens}) - k], '-')"))})))"
    return f"coalesce({dims.sql_lookup(dims.BY_SQUASH, _sq(x))}, list_filter({windows}, lambda w: w IS NOT NULL)[1])"


def _curve(x: str) -> str:
    return f"coalesce({dims.sql_lookup(dims.CURVES, f'lower(trim({x}))')}, {x})"


def _scaled(field: str) -> str:
    return f"coalesce({dims.sql_lookup(dims.scale(field), "family || '|' || parameter")}, {dims.sql_lookup(dims.scale(field), "family || '|*'")})"


def _canon(source: str) -> str:
    """CTEs that end in cn: source, a table with name and parameters, with the registry's columns."""
    bits = dims.scale("bits")
    return f"""f1 AS (SELECT *, {_family("name")} AS family FROM {source}), f2 AS (SELECT *, {dims.sql_lookup(dims.of("parameter"), "family")} AS fld FROM f1),
f3 AS (SELECT *, CASE WHEN fld IS NOT NULL THEN coalesce(CASE WHEN fld = 'curve' THEN {_curve("parameters['curve']")} ELSE parameters[fld] END,
 CASE WHEN fld = 'key_size' THEN list_filter(regexp_extract_all(name, '(\\d{{2,5}})', 1), lambda r: {dims.sql_lookup(bits, "family || '|' || r")} IS NOT NULL)[1]
  WHEN fld = 'curve' AND {dims.sql_lookup(bits, "family || '|' || " + _curve("name"))} IS NOT NULL THEN {_curve("name")} WHEN fld = 'version' THEN nullif(regexp_extract(name, '(\\d+\\.\\d+)', 1), '') END,
 {dims.sql_lookup(dims.of("default"), "family")}) END AS parameter, {dims.sql_lookup(dims.TEMPLATES, "family")} AS tpl, {dims.sql_lookup(dims.of("primitive"), "family")} AS prim, {dims.sql_lookup(dims.of("quantum"), "family")} AS st, {dims.sql_lookup(dims.of("attack"), "family")} AS att FROM f2),
f4 AS (SELECT *, CASE WHEN tpl IS NOT NULL AND NOT contains(tpl, '{{p}}') THEN tpl WHEN tpl IS NOT NULL AND parameter IS NOT NULL THEN replace(tpl, '{{p}}', parameter) WHEN tpl IS NOT NULL OR parameter IS NULL THEN family ELSE family || '-' || parameter END AS base,
 coalesce({_scaled("bits")}, 0) AS sb FROM f3),
f5 AS (SELECT *, CASE WHEN family IS NOT NULL THEN sb END AS security_bits, CASE WHEN family IS NOT NULL THEN coalesce({_scaled("quantum_bits")}, CASE WHEN st = 'safe' THEN sb WHEN att = 'shor' THEN 0 WHEN att = 'grover' THEN sb // 2 ELSE sb END) END AS quantum_bits,
 CASE WHEN family IS NOT NULL THEN CASE WHEN nullif(parameters['mode'], '') IS NOT NULL AND prim IN ('block-cipher', 'stream-cipher', 'ae') THEN base || '-' || upper(parameters['mode']) ELSE base END END AS canonical_name FROM f4),
cn AS (SELECT *, CASE WHEN st = 'weakened' AND quantum_bits >= 128 THEN 'safe' ELSE st END AS quantum_status, {dims.sql_lookup(dims.of("classical"), "family")} AS classical_status, {_scaled("oids")} AS oid_registered, {_scaled("levels")} AS nist_level,
 {dims.sql_lookup(dims.of("standard"), "family")} AS standard FROM f5)"""


_MP = f"{_M}, {_V}, vm AS (SELECT run_id, asset_ref, map_from_entries(list(row(parameter, value))) AS parameters FROM v GROUP BY ALL), ma AS (SELECT m.*, coalesce(parameters, map([]::VARCHAR[], []::VARCHAR[])) AS parameters FROM m LEFT JOIN vm USING (run_id, asset_ref) WHERE asset_kind <> 'library')"
_SURFACE = "CASE WHEN surfaces = '' THEN 'source' ELSE split_part(surfaces, ',', 1) END"
_EFFORT = f"coalesce(greatest({dims.sql_lookup(dims.EFFORT_SURFACE, _SURFACE)}, {dims.sql_lookup(dims.EFFORT_KIND, 'asset_kind')}), {dims.EFFORT_DEFAULT})"
_A = f"""{_MP}, {_canon("ma")}, a1 AS (SELECT cn.* REPLACE (coalesce(quantum_status, 'unknown') AS quantum_status, coalesce(classical_status, 'unknown') AS classical_status), {_EFFORT} AS effort,
 coalesce({dims.sql_lookup(dims.SHELF_LIFE, "t.criticality")}, {dims.SHELF_LIFE["high"]}) AS shelf_life FROM cn LEFT JOIN (SELECT target_id, min(criticality) AS criticality FROM targets GROUP BY 1) t USING (target_id)),
a2 AS (SELECT *, quantum_status IN ('broken', 'weakened') AS vul, effort + shelf_life AS total FROM a1),
a3 AS (SELECT *, CASE WHEN vul THEN {" + ".join(f"(total > {z})::INT" for z in dims.SCENARIOS.values())} END AS tripped,
 CASE WHEN vul THEN array_to_string(list_filter([{", ".join(f"CASE WHEN total > {z} THEN '{n}' END" for n, z in dims.SCENARIOS.items())}], lambda x: x IS NOT NULL), ',') END AS trips,
 array_to_string(list_filter(['dst-nqm-vendor-cbom', CASE WHEN vul AND security_bits BETWEEN 1 AND 112 THEN 'nist-ir8547-deprecated' END, CASE WHEN vul THEN 'nist-ir8547-disallowed' END], lambda x: x IS NOT NULL), ',') AS milestones FROM a2),
a AS (SELECT *, CASE WHEN classical_status IN ('broken', 'disallowed') THEN 'critical' WHEN quantum_status = 'unknown' THEN 'medium' WHEN quantum_status = 'safe' THEN 'pq-safe' WHEN NOT vul THEN 'low' WHEN tripped = 3 THEN 'critical'
 WHEN contains(trips, 'median') THEN 'high' WHEN tripped > 0 THEN 'medium' ELSE 'low' END AS tier FROM a3)"""
_BY_ROLE = {f"{f}|{r}": t for f, e in dims.REPLACEMENTS.items() for r, t in e.items()}
_FIRST = {f: next(iter(e.values())) for f, e in dims.REPLACEMENTS.items()}
_ROLE = {k: ",".join(v) for k, v in dims.ROLES.items()}
_Q = f"""{_A}, q1 AS (SELECT *, coalesce(list_filter(list_transform(flatten(list_transform(string_split(functions, ','), lambda f: string_split(coalesce({dims.sql_lookup(_ROLE, "f")}, ''), ','))), lambda r: {dims.sql_lookup(_BY_ROLE, "family || '|' || r")}), lambda t: t IS NOT NULL)[1],
 {dims.sql_lookup(_FIRST, "family")}) AS goal FROM a),
q2 AS (SELECT *, CASE WHEN NOT (quantum_status = 'safe' AND classical_status NOT IN ('broken', 'disallowed', 'deprecated')) AND {_sq("goal")} <> {_sq("canonical_name")} THEN goal END AS recommended FROM q1),
q3 AS (SELECT *, {", ".join(f"CAST({dims.sql_lookup(dims.size_table(i), _sq('recommended'))} - {dims.sql_lookup(dims.size_table(i), _sq('canonical_name'))} AS BIGINT) AS delta_{f}" for i, f in enumerate(dims.SIZE_FIELDS))}, {dims.sql_lookup(dims.RISK_ORDER, "tier")} AS tier_order FROM q2),
rr AS (SELECT run_id, name, count(DISTINCT target_id) AS targets FROM a GROUP BY ALL),
q AS (SELECT q3.*, coalesce(rr.targets, 1) AS targets, {" + ".join(f"coalesce(greatest(0, delta_{f}), 0)" for f in dims.SIZE_FIELDS)} AS cost_bytes FROM q3 LEFT JOIN rr ON q3.run_id IS NOT DISTINCT FROM rr.run_id AND q3.name IS NOT DISTINCT FROM rr.name)"""
_ORDER = "ORDER BY tier_order, targets DESC, cost_bytes, asset_ref, run_id"
_REF = "regexp_replace(lower(trim(bom_ref)), '^urn:cbom:', '')"
_REFS = f"r AS (SELECT DISTINCT snapshot_no, {_REF} AS bom_ref FROM components WHERE regexp_full_match({_REF}, '[0-9a-f]{{16}}'))"
_BAG = {"confidence": "printf('%.4f', confidence)", "collectors": "collectors", "surfaces": "surfaces", "corroborated": "corroborated::VARCHAR", "target": "target_id", "evidence-tiers": "tiers", "location.0": "primary_location", "family": "fam", "quantum-status": dims.sql_lookup(dims.of("quantum"), "fam"), "classical-status": dims.sql_lookup(dims.of("classical"), "fam")}
_COMP = f"cc AS (SELECT *, CASE WHEN asset_kind = 'library' THEN 'library' ELSE 'cryptographic-asset' END AS type, {_family('name')} AS fam FROM m WHERE confidence >= {dims.FLOOR})"
_WHOLE = """mt AS (SELECT run_id, asset_ref, array_to_string(list_sort(list(DISTINCT matcher_id) FILTER (WHERE matcher_id IS NOT NULL)), ',') AS matchers FROM e GROUP BY ALL),
l AS (SELECT run_id, asset_ref, place, row_number() OVER (PARTITION BY run_id, asset_ref ORDER BY surface, place) - 1 AS n FROM (SELECT DISTINCT run_id, asset_ref, location, coalesce(location.surface, '') AS surface, place FROM k WHERE location IS NOT NULL))"""
_BYTES = "content::VARCHAR"
for _code in (0x0A, 0x0D, 0x09, 0x0C, 0x22, 0x27, 0x5C):  # bytes come as text with some of them as \\xHH
    _BYTES = f"replace({_BYTES}, '\\x{_code:02X}', chr({_code}))"
_SUFFIX = "lower(regexp_extract(path, '(\\.[A-Za-z]+)$', 1))"
_SOURCE = f"s AS (SELECT file_id, target_id, path, {dims.sql_lookup(detection.SUFFIXES, _SUFFIX)} AS lang, {_BYTES} AS text FROM source_files WHERE {dims.sql_lookup(detection.SUFFIXES, _SUFFIX)} IS NOT NULL AND octet_length(content) <= {detection.SOURCE_CAP})"
_TAKEN = "".join(
    f", t{i} AS (SELECT seq, CASE WHEN strpos(rest, '{t}') > 0 THEN left(rest, strpos(rest, '{t}') - 1) || substr(rest, strpos(rest, '{t}') + {len(t)}) ELSE rest END AS rest, CASE WHEN strpos(rest, '{t}') > 0 THEN list_append(hits, '{a}') ELSE hits END AS hits FROM t{i - 1})"
    for i, (t, a) in enumerate(detection.SUITE_TOKENS.items(), 1)
)
_RULES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (lang, call, *rule)) + ")" for lang, rules in detection.CALLS.items() for call, rule in rules.items())
_queue_cols = ", ".join(QUEUE)

ORACLE = {
    "prj_bom_ref": f"SELECT seq, {_KEY} AS canonical_key, substr(sha256({_KEY}), 1, 16) AS asset_ref FROM findings",
    "prj_location": f"SELECT seq, {_PLACE} AS place FROM findings",
    "jn_resolve_family": f"SELECT seq, {_family('name')} AS family FROM findings",
    "fn_canonicalise": f"WITH {_canon('findings')} SELECT seq, {', '.join(CANONICAL)} FROM cn",
    "agg_noisy_or": f"WITH {_K}, {_E} SELECT * FROM c",
    "agg_parameters": f"WITH {_K}, {_V} SELECT * FROM v",
    "agg_merge": f"WITH {_M} SELECT * FROM m",
    "agg_blast_radius": f"WITH {_M} SELECT run_id, name, count(DISTINCT target_id) AS targets FROM m GROUP BY ALL",
    "fn_risk_tier": f"WITH {_A} SELECT run_id, asset_ref, {', '.join(ASSESSED)} FROM a",
    "jn_mosca": f"WITH {_A} SELECT run_id, asset_ref, s.scenario, s.years - total AS margin_years, total > s.years AS trips FROM a CROSS JOIN (VALUES {', '.join(f"('{n}', {z})" for n, z in dims.SCENARIOS.items())}) s(scenario, years) WHERE vul",
    "jn_deadlines": f"WITH {_A}, x AS (SELECT run_id, asset_ref, unnest(string_split(milestones, ',')) AS milestone FROM a) SELECT *, {dims.sql_lookup({i: y - dims.REFERENCE_YEAR for i, y, _ in dims.MILESTONES}, 'milestone')} AS years_remaining FROM x",
    "agg_tier_summary": f"WITH {_A} SELECT t.tier, count(a.tier) AS assets FROM (VALUES {', '.join(f"('{t}')" for t in dims.RISK_ORDER)}) t(tier) LEFT JOIN a ON a.tier = t.tier GROUP BY ALL",
    "jn_recommend": f"WITH {_Q} SELECT run_id, asset_ref, recommended, {', '.join(f'delta_{f}' for f in dims.SIZE_FIELDS)}, cost_bytes FROM q",
    "srt_queue": f"WITH {_Q} SELECT {_queue_cols} FROM q {_ORDER}",
    "win_queue_rank": f"WITH {_Q} SELECT row_number() OVER ({_ORDER}) AS rank, run_id, asset_ref FROM q",
    "lim_top40": f"WITH {_Q} SELECT {_queue_cols} FROM q {_ORDER} LIMIT 40",
    "agg_cost_summary": f"WITH {_Q} SELECT recommended, count(*) AS actionable, CAST(coalesce(sum(cost_bytes), 0) AS BIGINT) AS cost_bytes FROM q WHERE recommended IS NOT NULL GROUP BY ROLLUP (recommended)",
    "flt_confidence_floor": f"WITH {_M} SELECT run_id, asset_ref, confidence FROM m WHERE confidence >= {dims.FLOOR}",
    "cbom_properties": f"WITH {_M}, {_COMP} " + " UNION ALL ".join(f"SELECT run_id, asset_ref AS bom_ref, type, name, '{dims.PREFIX}{k}' AS property, {v} AS value FROM cc WHERE ({v}) IS NOT NULL" for k, v in _BAG.items()),
    "cbom_bag": f"WITH {_M}, {_COMP}, {_WHOLE} " + " UNION ALL ".join(f"SELECT run_id, asset_ref AS bom_ref, type, name, '{dims.PREFIX}{k}' AS property, {v} AS value FROM cc WHERE ({v}) IS NOT NULL" for k, v in _BAG.items() if k != "location.0")
    + f""" UNION ALL SELECT run_id, asset_ref, type, name, '{dims.PREFIX}matchers', coalesce(matchers, '') FROM cc LEFT JOIN mt USING (run_id, asset_ref)
 UNION ALL SELECT run_id, asset_ref, type, name, '{dims.PREFIX}location.' || n, place FROM cc JOIN l USING (run_id, asset_ref)""",
    "cbom_serial": f"""WITH {_M}, {_COMP}, w AS (SELECT run_id, sha256(string_agg(asset_ref, '' ORDER BY asset_ref)) AS h FROM cc GROUP BY run_id)
SELECT run_id, 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS serial FROM w""",
    "set_common": f"WITH {_REFS} SELECT snapshot_no, bom_ref FROM r INTERSECT SELECT snapshot_no + 1, bom_ref FROM r",
    "agg_run_counters": """WITH f AS (SELECT target_id, count(*) AS findings, count(*) FILTER (WHERE asset_kind = 'library') AS libraries FROM findings GROUP BY 1), e AS (SELECT target_id, count(*) AS errors FROM errors GROUP BY 1)
SELECT coalesce(f.target_id, e.target_id) AS target_id, coalesce(findings, 0) AS findings, coalesce(libraries, 0) AS libraries, coalesce(errors, 0) AS errors, CASE WHEN coalesce(errors, 0) > 0 THEN 'error' ELSE 'complete' END AS status FROM f FULL JOIN e ON f.target_id IS NOT DISTINCT FROM e.target_id""",
    "flt_resume_skip": "SELECT target_id, kind FROM targets WHERE target_id NOT IN (SELECT target_id FROM errors WHERE target_id IS NOT NULL)",
    "jn_supports": "SELECT target_id, unnest(string_split(CASE kind WHEN 'container' THEN 'container' WHEN 'endpoint' THEN 'tls' ELSE 'source_ast,elf' END, ',')) AS collector FROM targets WHERE kind IN ('directory', 'file', 'container', 'endpoint')",
    "src_classify": """WITH t AS (SELECT target_id, coalesce(host || ':' || port, path) AS raw FROM targets) SELECT target_id, CASE WHEN regexp_matches(lower(raw), '\\.(tar|tar\\.gz|tgz|oci)$') THEN 'container'
 WHEN coalesce(try_cast(regexp_extract(raw, '^(?:\\[[0-9a-fA-F:]+\\]|[A-Za-z0-9._-]+):(\\d{1,5})$', 1) AS INT), 0) BETWEEN 1 AND 65535 THEN 'endpoint' ELSE 'unknown' END AS kind_said FROM t WHERE raw IS NOT NULL""",
    "det_transformation": f"""WITH s AS (SELECT seq, list_transform(string_split(name, '/'), lambda x: trim(x)) AS p FROM findings WHERE name IS NOT NULL)
SELECT seq, p[1] AS algorithm, lower(nullif(p[2], '')) AS mode, CASE WHEN nullif(p[3], '') IS NOT NULL THEN coalesce({dims.sql_lookup(detection.PADDINGS, "lower(p[3])")}, CASE WHEN starts_with(lower(p[3]), 'oaep') THEN 'oaep' ELSE 'other' END) END AS padding FROM s""",
    "agg_surface_facet": f"WITH {_Q}, s AS (SELECT unnest(string_split(surfaces, ',')) AS surface FROM q) SELECT surface, count(*) AS assets FROM s WHERE surface <> '' GROUP BY ALL",
    "lim_errors100": "SELECT error_id, target_id, phase, reason FROM errors ORDER BY reported_at DESC, error_id LIMIT 100",
    "src_packages": "SELECT * FROM (VALUES ('image-1', 'openssl', '3.0.2-0ubuntu1'), ('image-1', 'libssl3', '3:1.2'), ('image-1', 'libcrypto3', '3.1.4-r1')) t(target_id, package, version)",
    "det_suites": """SELECT * FROM (VALUES ('TLS_AES_256_GCM_SHA384', 0, 'AES-256-GCM'), ('TLS_AES_256_GCM_SHA384', 1, 'SHA-384'), ('TLS_AES_128_GCM_SHA256', 0, 'AES-128-GCM'), ('TLS_AES_128_GCM_SHA256', 1, 'SHA-256'),
 ('ECDHE-RSA-AES256-GCM-SHA384', 0, 'ECDH'), ('ECDHE-RSA-AES256-GCM-SHA384', 1, 'AES-256-GCM'), ('ECDHE-RSA-AES256-GCM-SHA384', 2, 'SHA-384'), ('ECDHE-RSA-AES256-SHA384', 0, 'ECDH'), ('ECDHE-RSA-AES256-SHA384', 1, 'AES-256-CBC'),
 ('DHE-RSA-AES128-SHA', 0, 'DH'), ('DHE-RSA-AES128-SHA', 1, 'AES-128-CBC'), ('DES-CBC3-SHA', 0, '3DES'), ('TLS_RSA_WITH_AES_128_CBC_SHA', 0, 'AES-128-CBC'), ('TLS_RSA_WITH_AES_128_CBC_SHA', 1, 'SHA-1'),
 ('ECDHE-ECDSA-CHACHA20-POLY1305', 0, 'ECDH'), ('ECDHE-ECDSA-CHACHA20-POLY1305', 1, 'ChaCha20'), ('RC4-MD5', 0, 'RC4')) t(suite, place, algorithm)""",
    "det_suite_names": f"""WITH t0 AS (SELECT seq, upper(name) AS rest, []::VARCHAR[] AS hits FROM findings WHERE name IS NOT NULL){_TAKEN}
SELECT seq, CAST(unnest(range(len(hits))) AS INT) AS place, unnest(hits) AS algorithm FROM t{len(detection.SUITE_TOKENS)}""",
    "src_package_texts": f"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n\\n+')) AS s FROM documents),
f AS (SELECT doc_id, {", ".join("coalesce(" + ", ".join(f"nullif(trim(regexp_extract(s, '(?m)^{n}:[ \\t]*(.*)$', 1)), '')" for n in names) + f") AS {c}" for c, names in (("package", ("Package", "P")), ("version", ("Version", "V"))))} FROM s)
SELECT DISTINCT doc_id, package, version FROM f WHERE regexp_matches(package, '^(?:{"|".join(detection.PACKAGES)})')""",
    "det_calls": f"""WITH {_SOURCE}, r AS (SELECT * FROM (VALUES {_RULES}) r(lang, call, algorithm, key_size, mode)),
c AS (SELECT file_id, target_id, path, lang, unnest(regexp_extract_all(regexp_replace(text, $re${detection.NOISE}$re$, ' ', 'g'), $re${detection.CALL}$re$, 1)) AS call FROM s)
SELECT file_id, target_id, path, c.call, algorithm, key_size, mode, count(*) AS hits FROM c JOIN r ON c.lang = r.lang AND c.call = r.call GROUP BY ALL""",
    "det_includes": f"""WITH {_SOURCE}, l AS (SELECT file_id, unnest(regexp_extract_all(text, $re$(?m)^[ \t]*(?:#[ \t]*include|import)?[ \t]*(?:static )?([<"][^\n]*[>"]|[a-z][A-Za-z0-9_.]*[*]?;)[ \t\r]*$$re$, 1)) AS line FROM s)
SELECT DISTINCT file_id, library FROM (SELECT file_id, CASE {" ".join(f"WHEN contains(line, '{n}') THEN '{lib}'" for n, lib in detection.INCLUDES.items())} END AS library FROM l) WHERE library IS NOT NULL""",
}
