"""Names resolved against the registry: family, parameter, canonical name, strength and status, all in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.session import materialised

SEPARATORS = r"[-_/\s.\x{00A0}\x{2000}-\x{200A}\x{3000}]+"


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9+]", "")


def family(raw: Column) -> Column:
    """The family of a name: of the whole name, else of its windows of tokens, the longest first, then the leftmost; null if none."""
    tokens = F.filter(F.split(F.lower(raw), SEPARATORS), lambda t: t != "")
    n = F.size(tokens)
    windows = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.sequence(F.lit(0), k), lambda s: dims.lookup(dims.BY_SQUASH, squash(F.array_join(F.slice(tokens, s + 1, n - k), "-")))))))
    return F.coalesce(dims.lookup(dims.BY_SQUASH, squash(raw)), F.get(F.filter(windows, lambda x: x.isNotNull()), F.lit(0)))


def curve(raw: Column) -> Column:
    return F.coalesce(dims.lookup(dims.CURVES, F.lower(F.trim(raw))), raw)


def scaled(field: str, fam: Column, parameter: Column) -> Column:
    table = dims.scale(field)
    return F.coalesce(dims.lookup(table, F.concat_ws("|", fam, parameter)), dims.lookup(table, F.concat(fam, F.lit("|*"))))


def canonicalised(df: DataFrame, name: str = "name", parameters: str = "parameters") -> DataFrame:
    """df with family, parameter, canonical_name, security_bits, quantum_bits, quantum_status, classical_status, oid_registered, nist_level, standard.

    A name of no family has nulls in all of them. Columns of df with these names are replaced.
    """
    raw, params = F.col(name), F.col(parameters)
    df = df.withColumn("family", family(raw))
    fam = F.col("family")
    field = dims.lookup(dims.of("parameter"), fam)
    given = F.try_element_at(params, field)
    runs = F.filter(F.regexp_extract_all(raw, F.lit(r"(\d{2,5})"), 1), lambda r: dims.lookup(dims.scale("bits"), F.concat_ws("|", fam, r)).isNotNull())
    in_name = (
        F.when(field == "key_size", F.get(runs, F.lit(0)))
        .when((field == "curve") & dims.lookup(dims.scale("bits"), F.concat_ws("|", fam, curve(raw))).isNotNull(), curve(raw))
        .when(field == "version", F.nullif(F.regexp_extract(raw, r"(\d+\.\d+)", 1), F.lit("")))
    )
    df = df.withColumn("parameter", F.when(field.isNotNull(), F.coalesce(F.when(field == "curve", curve(given)).otherwise(given), in_name, dims.lookup(dims.of("default"), fam))))
    p = F.col("parameter")
    template = dims.lookup(dims.TEMPLATES, fam)
    base = F.when(template.isNotNull() & ~template.contains("{p}"), template).when(template.isNotNull() & p.isNotNull(), F.replace(template, F.lit("{p}"), p)).when(template.isNotNull() | p.isNull(), fam).otherwise(F.concat_ws("-", fam, p))
    mode = F.nullif(F.try_element_at(params, F.lit("mode")), F.lit(""))
    primitive = dims.lookup(dims.of("primitive"), fam)
    attack, status = dims.lookup(dims.of("attack"), fam), dims.lookup(dims.of("quantum"), fam)
    bits = F.coalesce(scaled("bits", fam, p), F.lit(0))
    qbits = F.coalesce(scaled("quantum_bits", fam, p), F.when(status == "safe", bits).when(attack == "shor", 0).when(attack == "grover", F.floor(bits / 2).cast("int")).otherwise(bits))
    known = fam.isNotNull()
    df = df.withColumns({"canonical_name": F.when(known, F.when(mode.isNotNull() & primitive.isin(*dims.MODE_BEARING), F.concat_ws("-", base, F.upper(mode))).otherwise(base)), "security_bits": F.when(known, bits.cast("int")), "quantum_bits": F.when(known, qbits.cast("int"))})
    return df.withColumns(
        {
            "quantum_status": F.when((status == "weakened") & (F.col("quantum_bits") >= 128), "safe").otherwise(status),
            "classical_status": dims.lookup(dims.of("classical"), fam),
            "oid_registered": scaled("oids", fam, p),
            "nist_level": scaled("levels", fam, p),
            "standard": dims.lookup(dims.of("standard"), fam),
        }
    )


#: Distinct names up to which their resolutions are broadcast; more are joined by a shuffle, in which Spark splits hot names.
FEW = 200_000
COLUMNS = ("family", "parameter", "canonical_name", "security_bits", "quantum_bits", "quantum_status", "classical_status", "oid_registered", "nist_level", "standard")
_SAID = ("key_size", "curve", "version", "mode")


def canonicalised_once(df: DataFrame, name: str = "name", parameters: str = "parameters") -> DataFrame:
    """The same as canonicalised, with each distinct name and its parameters resolved once and joined back.

    df is evaluated twice: it should be a scan or materialised.
    """
    keys = {"__n": F.col(name), **{f"__{k}": F.try_element_at(parameters, F.lit(k)) for k in _SAID}}
    given = F.map_filter(F.create_map(*[x for k in _SAID for x in (F.lit(k), F.col(f"__{k}"))]), lambda k, v: v.isNotNull())
    once = canonicalised(df.select(*[c.alias(k) for k, c in keys.items()]).distinct().withColumn("__p", given), "__n", "__p").select(*[F.col(k).alias(f"r{k}") for k in keys], *[F.col(c).alias(f"r__{c}") for c in COLUMNS])
    once = materialised(once)
    if once.count() <= FEW:
        once = F.broadcast(once)
    rows = df.withColumns(keys)
    on = [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys]
    kept = [F.col(c) for c in df.columns if c not in COLUMNS]
    return rows.join(once, reduce(lambda a, b: a & b, on), "left").select(*kept, *[F.col(f"r__{c}").alias(c) for c in COLUMNS])


def registry(algorithms: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, registry_family: an operator's registry by squashed spelling; a family's own name goes before an entry's, that before an alias.

    Of equals the first family in order is taken. The tables are lists of names, whose size is that of the standards.
    """
    entries = algorithms.filter("entry_kind = 'algorithm'")
    named = entries.select("family", F.explode(F.array("family", "name")).alias("canonical")).distinct()
    spelled = (
        entries.select(squash(F.col("family")).alias("key"), "family", F.lit(0).alias("o"))
        .unionByName(entries.select(squash(F.col("name")).alias("key"), "family", F.lit(1).alias("o")))
        .unionByName(aliases.filter("entry_kind = 'algorithm'").join(named, "canonical").select(squash(F.col("alias")).alias("key"), "family", F.lit(2).alias("o")))
    )
    return spelled.filter("key <> ''").groupBy("key").agg(F.min_by("family", F.struct("o", "family")).alias("registry_family"))


def resolved(df: DataFrame, own: DataFrame, name: str = "name") -> DataFrame:
    """df with registry_family by the spelling of the whole name in own; null if it has none."""
    return df.withColumn("key", squash(F.col(name))).join(own, "key", "left").drop("key")
