"""The bill of materials: components with their property bags, and what two of them differ in."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators import canonical


def components(assets: DataFrame, include_low: bool = False, brief: bool = False) -> DataFrame:
    """run_id, bom_ref, type, name, description, properties of the assets above the confidence floor; the statuses are the family's own.

    The description is the primary location; the properties have every location by its number, and every matcher. If brief, they have
    the primary location only, as location.0, and no matchers: what the SQL of cbom_properties has.
    """
    df = assets if include_low else assets.filter(F.col("confidence") >= dims.FLOOR)
    df = df.withColumn("__family", canonical.family(F.col("name")))  # a column of its own, or it is evaluated for each property
    fam = F.col("__family")
    entry = lambda k, v: F.struct((F.concat(F.lit(dims.PREFIX), k) if isinstance(k, Column) else F.lit(dims.PREFIX + k)).alias("name"), v.alias("value"))
    head = {"confidence": F.format_string("%.4f", "confidence"), "collectors": F.col("collectors"), "surfaces": F.col("surfaces"), "corroborated": F.col("corroborated").cast("string"), "target": F.col("target_id"), "evidence-tiers": F.col("tiers")}
    tail = {"family": fam, "quantum-status": dims.lookup(dims.of("quantum"), fam), "classical-status": dims.lookup(dims.of("classical"), fam)}
    if brief:
        bag = F.array(*[entry(k, v) for k, v in {**head, "location.0": F.col("primary_location"), **tail}.items()])
    else:
        places = F.transform("locations", lambda x, i: entry(F.concat(F.lit("location."), i.cast("string")), x))
        bag = F.concat(F.array(*[entry(k, v) for k, v in {**head, "matchers": F.col("matchers")}.items()]), places, F.array(*[entry(k, v) for k, v in tail.items()]))
    entries = F.filter(bag, lambda p: p["value"].isNotNull())
    kind = F.when(F.col("asset_kind") == "library", "library").otherwise("cryptographic-asset")
    return df.select("run_id", F.col("asset_ref").alias("bom_ref"), kind.alias("type"), "name", F.col("primary_location").alias("description"), entries.alias("properties"))


# The vocabularies of a component's properties, and how names of protocols begin.
PRIMITIVES = ("drbg", "mac", "block-cipher", "stream-cipher", "signature", "hash", "pke", "xof", "kdf", "key-agree", "kem", "ae", "combiner", "key-wrap", "other", "unknown")
MODES = ("cbc", "ecb", "ccm", "gcm", "cfb", "ofb", "ctr", "other", "unknown")
PADDINGS = ("pkcs5", "pkcs7", "pkcs1v15", "oaep", "raw", "other", "unknown")
FUNCTIONS = ("generate", "keygen", "encrypt", "decrypt", "digest", "tag", "keyderive", "sign", "verify", "encapsulate", "decapsulate", "other", "unknown")
MATERIALS = ("private-key", "public-key", "secret-key", "key", "ciphertext", "signature", "digest", "initialization-vector", "nonce", "seed", "salt", "shared-secret", "tag", "additional-data", "password", "credential", "token", "other", "unknown")
PROTOCOLS = ("TLS", "SSH", "IPSEC", "IKE", "QUIC", "DTLS")


def crypto_properties(assets: DataFrame) -> DataFrame:
    """run_id, bom_ref and the typed properties of the assets that are no library; what a vocabulary lacks is null.

    asset_type; of algorithms primitive, parameter_set, curve, mode, padding, crypto_functions, classical_level and nist_level; of protocols
    protocol_type and protocol_version; of material material_type and material_size; oid.
    """
    df = canonical.canonicalised(assets.filter("asset_kind <> 'library'"))
    given = lambda k: F.try_element_at("parameters", F.lit(k))
    known = lambda c, words: F.when(F.lower(c).isin(*words), F.lower(c))
    kind = F.col("asset_kind")
    algorithm, protocol, material = kind == "algorithm", kind == "protocol", kind == "related-crypto-material"
    said = F.upper(F.coalesce(F.nullif(given("protocol"), F.lit("")), F.col("name")))
    protocol_type = F.coalesce(*[F.when(said.startswith(p), p.lower()) for p in PROTOCOLS], F.lit("other"))
    functions = F.array_join(F.filter(F.split("functions", ","), lambda f: f.isin(*FUNCTIONS)), ",")
    return df.select(
        "run_id", F.col("asset_ref").alias("bom_ref"), kind.alias("asset_type"), F.when(algorithm, known(F.col("primitive"), PRIMITIVES)).alias("primitive"), F.when(algorithm, given("key_size")).alias("parameter_set"), F.when(algorithm, given("curve")).alias("curve"),
        F.when(algorithm, known(given("mode"), MODES)).alias("mode"), F.when(algorithm, known(given("padding"), PADDINGS)).alias("padding"), F.when(algorithm, functions).alias("crypto_functions"), F.when(algorithm, F.col("security_bits")).alias("classical_level"), F.when(algorithm, F.col("nist_level")).alias("nist_level"),
        F.when(protocol, protocol_type).alias("protocol_type"), F.when(protocol, F.coalesce(given("version"), F.lit(""))).alias("protocol_version"),
        F.when(material, F.coalesce(known(given("material_type"), MATERIALS), F.lit("key"))).alias("material_type"), F.when(material, given("key_size").try_cast("int")).alias("material_size"), "oid",
    )


def serial(comps: DataFrame) -> DataFrame:
    """run_id, serial: a version-4 shaped identifier of each run's references in order, the same whenever they are.

    The references are sorted by Spark, which spills, and hashed as they stream by; no task holds a run's.
    """
    kinds = dict(comps.dtypes)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, h = None, None
        for pdf in batches:
            for own, refs in pdf.groupby("run_id", sort=False, dropna=False)["bom_ref"]:
                own = None if pd.isna(own) else own
                if h is None or own != run:
                    if h is not None:
                        yield pd.DataFrame({"run_id": [run], "serial": [_urn(h)]})
                    run, h = own, hashlib.sha256()
                h.update("".join(refs).encode())
        if h is not None:
            yield pd.DataFrame({"run_id": [run], "serial": [_urn(h)]})

    refs = comps.select("run_id", "bom_ref").repartition("run_id").sortWithinPartitions("run_id", "bom_ref")
    return refs.mapInPandas(hashed, f"run_id {kinds['run_id']}, serial string")


def _urn(h) -> str:
    return uuid.UUID(bytes=h.digest()[:16], version=4).urn
