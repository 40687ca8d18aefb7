"""Assets held against timelines and milestones, and ordered for migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators import canonical
from keelson.operators.assets import reach
from keelson.session import materialised


def assessed(assets: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """assets without libraries, with the registry's columns, effort, shelf_life, trips, tripped, milestones and tier.

    targets gives the criticality of a target; a target without one counts as high. A name of no family is unknown and so medium.
    """
    df = canonical.canonicalised(assets.filter("asset_kind <> 'library'"))
    if targets is not None:
        crit = targets.groupBy("target_id").agg(F.min("criticality").alias("criticality"))
        df = df.join(crit, "target_id", "left")
    else:
        df = df.withColumn("criticality", F.lit(None).cast("string"))
    surface = F.get(F.split("surfaces", ","), F.lit(0))
    effort = F.coalesce(F.greatest(dims.lookup(dims.EFFORT_SURFACE, F.when(surface == "", "source").otherwise(surface)), dims.lookup(dims.EFFORT_KIND, F.col("asset_kind"))), F.lit(dims.EFFORT_DEFAULT))
    shelf = F.coalesce(dims.lookup(dims.SHELF_LIFE, F.col("criticality")), F.lit(dims.SHELF_LIFE["high"]))
    df = df.withColumns({"effort": effort, "shelf_life": shelf, "quantum_status": F.coalesce("quantum_status", F.lit("unknown")), "classical_status": F.coalesce("classical_status", F.lit("unknown"))})
    vulnerable = F.col("quantum_status").isin("broken", "weakened")
    total = F.col("effort") + F.col("shelf_life")
    trips = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(z).alias("z")) for n, z in dims.SCENARIOS.items()]), lambda s: total > s["z"])
    df = df.withColumn("trips", F.when(vulnerable, F.array_join(F.transform(trips, lambda s: s["name"]), ",")))
    tripped = F.when(vulnerable, F.size(trips))
    rules = {"all": F.lit(True), "quantum_vulnerable": vulnerable, "quantum_vulnerable_112": vulnerable & F.col("security_bits").between(1, 112)}
    due = F.array_compact(F.array(*[F.when(rules[r], F.lit(i)) for i, _, r in sorted(dims.MILESTONES, key=lambda m: m[1])]))
    df = df.withColumns({"tripped": tripped, "milestones": F.array_join(due, ",")})
    tier = (
        F.when(F.col("classical_status").isin("broken", "disallowed"), "critical")
        .when(F.col("quantum_status") == "unknown", "medium").when(F.col("quantum_status") == "safe", "pq-safe").when(~vulnerable, "low")
        .when(F.col("tripped") == len(dims.SCENARIOS), "critical").when(F.contains("trips", F.lit("median")), "high").when(F.col("tripped") > 0, "medium").otherwise("low")
    )
    return df.withColumn("tier", tier)


def entry() -> Column:
    """family|role of the replacement of an assessed asset: of the first of its roles that the table has, else the family's first."""
    keys = {f"{f}|{r}": f"{f}|{r}" for f, e in dims.REPLACEMENTS.items() for r in e}
    first = {f: f"{f}|{next(iter(e))}" for f, e in dims.REPLACEMENTS.items()}
    roles = F.flatten(F.transform(F.split("functions", ","), lambda f: F.split(F.coalesce(dims.lookup({k: ",".join(v) for k, v in dims.ROLES.items()}, f), F.lit("")), ",")))
    fitting = F.filter(F.transform(roles, lambda r: dims.lookup(keys, F.concat_ws("|", F.col("family"), r))), lambda t: t.isNotNull())
    return F.coalesce(F.get(fitting, F.lit(0)), dims.lookup(first, F.col("family")))


def replacement() -> Column:
    """What an assessed asset is replaced by; null if it is safe or already that."""
    target = dims.lookup({f"{f}|{r}": t for f, e in dims.REPLACEMENTS.items() for r, t in e.items()}, entry())
    safe = (F.col("quantum_status") == "safe") & ~F.col("classical_status").isin("broken", "disallowed", "deprecated")
    return F.when(~safe & (canonical.squash(target) != canonical.squash(F.col("canonical_name"))), target)


def detailed(queue: DataFrame) -> DataFrame:
    """queue with standard, hybrid, alternative, rationale and latency of what is recommended, and what it costs: deltas and headline.

    deltas has field, before, after, delta and ratio of the sizes that both have, in the order of SIZE_FIELDS; headline is the one of
    the field that matters most to a migration: signature, ciphertext, public key, private key.
    """
    df = queue.withColumn("__entry", F.when(F.col("recommended").isNotNull(), entry()))
    part = lambda i: dims.lookup({k: v[i] for k, v in dims.REPLACEMENT_DETAILS.items() if v[i] is not None}, F.col("__entry"))
    now, then = canonical.squash(F.col("canonical_name")), canonical.squash(F.col("recommended"))

    def size(field: str) -> Column:
        i = dims.SIZE_FIELDS.index(field)
        a, b = dims.lookup(dims.size_table(i), now), dims.lookup(dims.size_table(i), then)
        ratio = F.when(a > 0, F.round(b / a, 1))
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.lit(field).alias("field"), a.cast("int").alias("before"), b.cast("int").alias("after"), (b - a).cast("int").alias("delta"), ratio.alias("ratio")))

    df = df.withColumns({"standard": part(0), "hybrid": part(1), "alternative": part(2), "rationale": part(3), "latency_note": dims.lookup(dims.LATENCY, F.col("recommended")), "deltas": F.array_compact(F.array(*[size(f) for f in dims.SIZE_FIELDS]))})
    at = lambda f: F.get(F.filter("deltas", lambda d: d["field"] == f), F.lit(0))
    return df.withColumn("headline", F.coalesce(*[at(f) for f in ("signature", "ciphertext", "public_key", "private_key")])).drop("__entry")


def described(delta: Column) -> Column:
    """A delta in words."""
    sizes = F.concat(delta["field"], F.lit(" "), delta["before"].cast("string"), F.lit(" B -> "), delta["after"].cast("string"), F.lit(" B"))
    return F.when(delta["ratio"].isNull(), sizes).otherwise(F.concat(sizes, F.lit(" ("), F.when(delta["delta"] >= 0, "+").otherwise(""), delta["delta"].cast("string"), F.lit(" B, "), F.format_string("%.1f", delta["ratio"]), F.lit("x)")))


def reason() -> Column:
    """Why an assessed asset has its tier."""
    n = F.lit(str(len(dims.SCENARIOS)))
    count = lambda text: F.concat(F.lit(text), F.col("tripped").cast("string"), F.lit(" of "), n, F.lit(")."))
    return (
        F.when(F.col("classical_status").isin("broken", "disallowed"), F.coalesce(dims.lookup(dims.CLASSICAL_NOTES, F.col("family")), F.lit("Already unsound under classical cryptanalysis.")))
        .when(F.col("quantum_status") == "unknown", "Algorithm not in the registry; classify manually before dismissing.").when(F.col("quantum_status") == "safe", "Not quantum-vulnerable at current understanding.")
        .when(F.col("tripped").isNull(), "Quantum-vulnerable but no migration window computed.")
        .when(F.col("tripped") == len(dims.SCENARIOS), F.concat(F.lit("Mosca's inequality trips under all "), n, F.lit(" scenarios (X="), F.col("effort").cast("string"), F.lit("y + Y="), F.col("shelf_life").cast("string"), F.lit("y).")))
        .when(F.contains("trips", F.lit("median")), count("Mosca's inequality trips under the median scenario (")).when(F.col("tripped") > 0, count("Mosca's inequality trips only under the pessimistic scenario ("))
        .when(F.col("quantum_status") == "weakened", "Grover halves the effective key length but the margin still holds.").otherwise("Quantum-vulnerable but the migration window is not yet closing.")
    )


def queue(assessments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """assessments with recommended, byte deltas by field, cost_bytes and targets, the reach of the name.

    names: run_id, name, targets; as the assets' names and targets are those of their sightings, it can come from these, which saves
    merging them twice.
    """
    df = assessments.withColumn("recommended", replacement())
    now, then = canonical.squash(F.col("canonical_name")), canonical.squash(F.col("recommended"))
    deltas = {f"delta_{f}": dims.lookup(dims.size_table(i), then) - dims.lookup(dims.size_table(i), now) for i, f in enumerate(dims.SIZE_FIELDS)}
    df = df.withColumns(deltas)
    cost = sum((F.coalesce(F.greatest(F.lit(0), F.col(c)), F.lit(0)) for c in deltas), F.lit(0))
    names = (reach(assessments) if names is None else names).withColumnsRenamed({"run_id": "r_run", "name": "r_name"})
    df = df.withColumns({"cost_bytes": cost.cast("bigint"), "tier_order": dims.lookup(dims.RISK_ORDER, F.col("tier"))})
    return df.join(names, F.col("run_id").eqNullSafe(F.col("r_run")) & F.col("name").eqNullSafe(F.col("r_name")), "left").drop("r_run", "r_name").withColumn("targets", F.coalesce("targets", F.lit(1)))


ORDER = ["tier_order", "-targets", "cost_bytes", "asset_ref", "run_id"]


def ordered(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """df in the queue's order, by a distributed sort."""
    return df.orderBy(*[F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in order or ORDER])


def ranked(df: DataFrame, order: list[str] | None = None, name: str = "rank") -> DataFrame:
    """ordered df with 1-based places. Places are counted in each sorted partition; no task sees all rows."""
    kept = materialised(ordered(df, order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).collect()  # one row for each partition
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        before[r["__part"]], total = total, total + r["__n"]
    offset = dims.lookup(before or {0: 0}, part)
    return kept.withColumn(name, (offset + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint")).drop("__at")
