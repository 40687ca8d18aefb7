"""Sightings from source text and binaries: call sites and includes by a tokenizer, joined with the rules, as rows of the findings schema.

The tokenizer is the only Python; rules are a table, so that an operator's own are a union away, and what a rule makes of a call is
expressions over the joined columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators import canonical, detection

RULE = "lang string, ord int, id string, call_name string, receiver string, algorithm string, parameters map<string,string>, functions array<string>, library string, arg_kind string, arg_index int, skip_unresolved boolean"
# Functions that a sighting may have; sonames' beginnings and the libraries they are of, in order.
FUNCTIONS = ("generate", "keygen", "encrypt", "decrypt", "sign", "verify", "encapsulate", "decapsulate", "digest", "tag", "keyderive", "other")
SONAMES = {"libcrypto": "openssl", "libssl": "openssl", "libsodium": "libsodium", "libmbedcrypto": "mbedtls", "libmbedtls": "mbedtls", "libmbedx509": "mbedtls", "libgcrypt": "libgcrypt", "libgnutls": "gnutls", "libnss3": "nss", "libsoftokn3": "nss", "libfreebl3": "nss", "libcryptopp": "cryptopp", "libwolfssl": "wolfssl", "libtomcrypt": "libtomcrypt"}
#: What the kinds of argument in operators' own rules read.
KINDS = {"string": "algorithm", "int": "key_size", "identifier": "curve_nid"}

_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.DOTALL)
_CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")
_INCLUDE = {"c": re.compile(r"^[ \t]*#[ \t]*include[^\n]*", re.MULTILINE), "java": re.compile(r"^[ \t]*import\b[^;\n]*;?", re.MULTILINE), "go": re.compile(r"^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?\"[^\"\n]+\"", re.MULTILINE)}
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", re.MULTILINE | re.DOTALL)
_BEFORE = frozenset("return else case throw go defer await co_return co_await do in not and or sizeof yield assert".split())


def _blanked(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", "\0", m[0][1:-1]) + m[0][-1:]


def _arguments(text: str, plain: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens at at, and where it closes; a bracket that doesn't close ends with the text."""
    depth, begin, out = 0, at + 1, []
    for m in re.compile(r"[()\[\]{},]").finditer(plain, at):
        ch = m[0]
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
            if not depth:
                if plain[begin : m.start()].strip():
                    out.append(text[begin : m.start()].strip())
                return out, m.end()
        elif depth == 1:
            out.append(text[begin : m.start()].strip())
            begin = m.end()
    return out, len(text)


def call_sites(lang: str, text: str, names: frozenset[str]) -> Iterator[tuple[int, str | None, str, list[str], str]]:
    """line, receiver, name, arguments, snippet of the calls of names. Definitions, macros' bodies, comments and strings have none."""
    plain = _NOISE.sub(_blanked, text)
    if lang == "c":
        plain = _DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), plain)
    for m in _CALL.finditer(plain):
        if m[1] not in names:
            continue
        head = plain[: m.start()].rstrip()
        receiver, begin = None, m.start()
        joint = next((j for j in ((".", "->", "::") if lang == "c" else (".",)) if head.endswith(j)), None)
        if joint:
            operand = re.search(r"([\w$]+|[)\]])\s*$", head[: -len(joint)])
            receiver = operand[1] if operand else ""
            begin = operand.start() if operand else begin
        elif head and (head[-1].isalnum() or head[-1] in "_$"):
            if re.search(r"[\w$]+$", head)[0] not in _BEFORE:
                continue
        args, end = _arguments(text, plain, m.end() - 1)
        yield text.count("\n", 0, m.start()) + 1, receiver, m[1], args, text[begin:end].strip()[:160]


def _includes(lang: str, text: str) -> Iterator[tuple[int, str]]:
    plain = re.sub(r"/\*.*?(?:\*/|\Z)|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL) if lang != "go" else text
    for m in _INCLUDE[lang].finditer(plain):
        yield text.count("\n", 0, m.start()) + 1, text[m.start() : m.end()].strip()[:120]


def rules(spark: SparkSession, own: DataFrame | None = None) -> DataFrame:
    """The call rules, with those of an operator behind them; C++ files are read with the rules of C."""
    shipped = spark.createDataFrame(detection.rule_rows(), RULE)
    if own is None:
        return shipped
    kind = F.coalesce(*[F.when(F.col("arg_kind") == k, v) for k, v in KINDS.items()], F.col("arg_kind"))
    usable = own.filter("call_name IS NOT NULL").select(F.when(F.col("lang") == "cpp", "c").otherwise(F.col("lang")).alias("lang"), (F.col("ord") + 1000).cast("int").alias("ord"), "id", "call_name", "receiver", "algorithm", "parameters", "functions", "library", F.when(F.col("arg_index").isNotNull(), kind).alias("arg_kind"), "arg_index", F.coalesce("skip_unresolved", F.lit(False)).alias("skip_unresolved"))
    return shipped.unionByName(usable)


_SITE = "file_id bigint, target_id string, path string, lang string, line int, receiver string, name string, args array<string>, snippet string"


def sites(files: DataFrame, names: list[str]) -> DataFrame:
    """The calls of names and the includes of files (file_id, target_id, path, content); an include has no name.

    Files of another suffix have no rows; bytes that aren't UTF-8 are replaced. A null content is an empty file.
    """
    wanted = frozenset(names)
    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), "target_id", "path", detection.suffix_language(F.col("path")).alias("lang"), "content").filter(f"lang IS NOT NULL AND content IS NOT NULL AND length(content) <= {detection.SOURCE_CAP}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for f, t, p, lang, c in zip(pdf["file_id"], pdf["target_id"], pdf["path"], pdf["lang"], pdf["content"]):
                text = bytes(c).decode("utf-8", "replace")
                out += [(f, t, p, lang, line, r, n, a, s) for line, r, n, a, s in call_sites(lang, text, wanted)]
                out += [(f, t, p, lang, line, None, None, None, s) for line, s in _includes(lang, text)]
            yield pd.DataFrame(out, columns=["file_id", "target_id", "path", "lang", "line", "receiver", "name", "args", "snippet"])

    return rows.mapInPandas(read, _SITE)


def source_errors(files: DataFrame) -> DataFrame:
    """target_id, collector, phase, reason, path of the files of a known suffix that are not read: without content, or over the cap."""
    rows = files.select("target_id", "path", detection.suffix_language(F.col("path")).alias("lang"), F.length("content").alias("n")).filter("lang IS NOT NULL")
    reason = F.when(F.col("n").isNull(), "no content").when(F.col("n") > detection.SOURCE_CAP, F.format_string("larger than %d bytes", F.lit(detection.SOURCE_CAP)))
    return rows.select("target_id", F.lit("source_ast").alias("collector"), F.lit("read").alias("phase"), reason.alias("reason"), "path").filter("reason IS NOT NULL")


def _literal(arg: Column) -> Column:
    """What a string literal says; null if the argument is none."""
    return F.when(arg.rlike(r"^(?:\"(?:[^\"\\\n]|\\.)*\"|'[^']*')$"), F.substr(arg, F.lit(2), F.length(arg) - 2)).when(arg.rlike("^`[^`]*`$"), arg)


def built(calls: DataFrame, table: DataFrame) -> DataFrame:
    """The sightings that the rules of table make of calls: every rule of a call's name, language and receiver.

    A direct call is the strongest evidence; an argument that isn't known statically makes it weaker, and so does a name that the registry
    doesn't have. A rule that skips what it can't resolve gives no sighting then.
    """
    r = table.select(*[F.col(c).alias(f"r_{c}") for c in table.columns])
    hit = calls.filter("name IS NOT NULL").join(r, (F.col("lang") == F.col("r_lang")) & (F.col("name") == F.col("r_call_name")) & (F.col("r_receiver").isNull() | F.col("r_receiver").eqNullSafe(F.col("receiver"))))
    arg = F.get("args", F.col("r_arg_index"))
    text = _literal(arg)
    spec = detection.transformation(text)
    size = F.nullif(F.regexp_extract(arg, r"^(\d+)[uUlL]*$", 1), F.lit(""))
    curve = dims.lookup(detection.CURVE_NIDS, arg)
    of = lambda *k: F.coalesce(F.col("r_arg_kind").isin(*k), F.lit(False))
    named = of("algorithm", "jca_spec")
    algorithm = F.when(named & text.isNull(), F.coalesce("r_algorithm", "r_library")).when(of("algorithm"), text).when(of("jca_spec"), spec["algorithm"]).otherwise(F.col("r_algorithm"))
    tier = F.when(named & text.isNull(), "linked_library_unpinned").when((of("key_size") & size.isNull()) | (of("curve_nid") & curve.isNull()), "linked_library_pinned").otherwise("direct_api_call")
    more = F.array(F.struct(F.lit("mode").alias("k"), F.when(of("jca_spec"), spec["mode"]).alias("v")), F.struct(F.lit("padding").alias("k"), F.when(of("jca_spec"), spec["padding"]).alias("v")), F.struct(F.lit("key_size").alias("k"), F.when(of("key_size"), size).alias("v")), F.struct(F.lit("curve").alias("k"), F.when(of("curve_nid"), curve).alias("v")))
    said = F.filter(more, lambda x: x["v"].isNotNull())
    hit = hit.withColumn("said", said).withColumn("raw", algorithm).withColumn("tier", tier).filter(~(F.coalesce("r_skip_unresolved", F.lit(False)) & named & text.isNull()) & F.coalesce(F.col("raw") != "", F.lit(False)))
    return _resolved(hit, F.coalesce("r_parameters", F.create_map().cast("map<string,string>")), F.col("said"), F.col("r_functions"))


def _resolved(hit: DataFrame, parameters: Column, said: Column, functions: Column) -> DataFrame:
    """hit with name, primitive, parameters, oid, functions and tier as the registry has them for raw."""
    known = F.filter(F.transform(F.map_entries(parameters), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))), lambda x: ~F.exists(said, lambda y: y["k"] == x["k"]))
    given = F.map_from_entries(F.concat(known, said))
    got = canonical.canonicalised(hit.withColumn("given", given), "raw", "given")
    field = dims.lookup(dims.of("parameter"), F.col("family"))
    own = F.filter(F.map_entries("given"), lambda e: ~e["key"].eqNullSafe(field))
    full = F.when(F.col("family").isNull() | field.isNull() | F.col("parameter").isNull(), F.col("given")).otherwise(F.map_from_entries(F.concat(own, F.array(F.struct(field.alias("key"), F.col("parameter").alias("value"))))))
    unknown = F.col("family").isNull()
    return got.withColumns({
        "parameters": full, "asset_name": F.coalesce("canonical_name", "raw"), "primitive": F.coalesce(dims.lookup(dims.of("primitive"), F.col("family")), F.lit("unknown")), "oid": F.col("oid_registered"),
        "functions": F.when(unknown, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(F.coalesce(functions, F.array().cast("array<string>")), lambda f: f.isin(*FUNCTIONS))))),
        "unresolved": unknown, "tier": F.when(unknown, "string_literal").otherwise(F.col("tier")),
    })


def _row(df: DataFrame, kind: str, collector: str, **c: Column) -> DataFrame:
    """df in the findings schema without seq, run_id and observed_at; c has the columns that differ."""
    null = F.lit(None)
    get = lambda k, other: c.get(k, other)
    location = F.struct(F.lit("source" if collector == "source_ast" else collector).alias("surface"), get("path", F.col("path")).alias("path"), get("line", null).cast("int").alias("line"), get("offset", null).cast("bigint").alias("byte_offset"), get("layer", null).cast("string").alias("layer_digest"), get("endpoint", null).cast("string").alias("endpoint"))
    none = F.create_map().cast("map<string,string>")
    evidence = F.array(F.struct(c["tier"].alias("tier"), c["matcher"].alias("matcher_id"), c["snippet"].alias("snippet"), get("detail", none).alias("detail")))
    return df.select(
        "target_id", F.lit(kind).alias("asset_kind"), c["name"].alias("name"), get("primitive", F.lit("unknown")).alias("primitive"), get("parameters", none).alias("parameters"), get("oid", null).cast("string").alias("oid"), get("functions", F.array().cast("array<string>")).alias("functions"),
        get("library", null).cast("string").alias("library"), F.lit(collector).alias("collector"), dims.lookup(dims.TIERS, c["tier"]).alias("confidence"), location.alias("location"), evidence.alias("evidence"),
    )


def from_sources(files: DataFrame, table: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """The sightings of source files, of calls and of libraries; a library counts once for each file, at its last include.

    names are the calls to look for, by default those of table, which is a list of rules and bounded.
    """
    spark = files.sparkSession
    table = rules(spark) if table is None else table
    if names is None:
        names = [r[0] for r in table.select("call_name").distinct().collect()]
    found = sites(files, names)
    calls = built(found, table)
    calls = _row(calls, "algorithm", "source_ast", name=F.col("asset_name"), primitive=F.col("primitive"), parameters=F.col("parameters"), oid=F.col("oid"), functions=F.col("functions"), library=F.col("r_library"), line=F.col("line"), tier=F.col("tier"), matcher=F.col("r_id"), snippet=F.col("snippet"), detail=F.when(F.col("unresolved"), F.create_map(F.lit("unresolved"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>")))
    lib = F.lit(None).cast("string")
    for needle, library in reversed(detection.INCLUDES.items()):
        lib = F.when(F.contains("snippet", F.lit(needle)), library).otherwise(lib)
    used = found.filter("name IS NULL").withColumn("lib", lib).filter("lib IS NOT NULL").groupBy("file_id", "target_id", "path", "lib").agg(F.max(F.struct("line", "snippet")).alias("at"))
    libs = _row(used, "library", "source_ast", name=F.col("lib"), library=F.col("lib"), line=F.col("at.line"), tier=F.lit("linked_library_unpinned"), matcher=F.concat(F.lit("include."), "lib"), snippet=F.col("at.snippet"))
    return calls.unionByName(libs)


def from_binaries(facts: DataFrame, surface: str = "elf") -> DataFrame:
    """The sightings of binaries' facts (of sources.binaries.elf_facts); surface is container for members of images."""
    spark = facts.sparkSession
    place = {"layer": F.col("layer_digest"), "path": F.col("path")}
    lib = F.lit(None).cast("string")
    for prefix, library in reversed(SONAMES.items()):
        lib = F.when(F.lower("name").startswith(prefix), library).otherwise(lib)
    needed = facts.filter("kind = 'needed'").withColumn("lib", lib).filter("lib IS NOT NULL")
    soname = F.create_map(F.lit("soname"), F.col("name"))
    out = _row(needed, "library", surface, name=F.col("lib"), library=F.col("lib"), parameters=soname, tier=F.lit("linked_library_unpinned"), matcher=F.concat(F.lit("dt_needed."), "lib"), snippet=F.col("name"), detail=soname, **place)
    table = rules(spark).filter("lang = 'c' AND algorithm IS NOT NULL").select("id", "call_name", F.col("algorithm").alias("raw"), F.col("parameters").alias("p"), F.col("functions").alias("fs"), F.col("library").alias("lib"))
    symbols = facts.filter("kind = 'symbol'").drop("algorithm").join(table, F.col("name") == F.col("call_name")).withColumn("tier", F.lit("linked_library_pinned"))
    none = F.array().cast("array<struct<k:string,v:string>>")
    symbols = _resolved(symbols, F.col("p"), none, F.col("fs"))
    common = {"name": F.col("asset_name"), "primitive": F.col("primitive"), "parameters": F.col("parameters"), "oid": F.col("oid"), "functions": F.col("functions"), "tier": F.col("tier"), **place}
    out = out.unionByName(_row(symbols.filter("NOT unresolved"), "algorithm", surface, library=F.col("lib"), matcher=F.col("id"), snippet=F.col("name"), **common))
    constants = facts.filter("kind = 'constant'").withColumn("raw", F.col("algorithm")).withColumn("tier", F.lit("crypto_constant"))
    constants = _resolved(constants, F.create_map().cast("map<string,string>"), none, F.array().cast("array<string>"))
    return out.unionByName(_row(constants.filter("NOT unresolved"), "algorithm", surface, offset=F.col("byte_offset"), matcher=F.col("name"), snippet=F.col("name"), **common))


def from_packages(df: DataFrame, kind: Column) -> DataFrame:
    """The sightings of packages (target_id, package, version, layer_digest); kind is the database's, dpkg or apk."""
    version = F.when(F.col("version").isNotNull(), F.create_map(F.lit("library_version"), F.col("version"))).otherwise(F.create_map().cast("map<string,string>"))
    return _row(df, "library", "container", name=F.col("package"), library=F.col("package"), parameters=version, path=F.concat(kind, F.lit(" package database")), layer=F.col("layer_digest"), tier=F.lit("filename_metadata"), matcher=F.concat(F.lit("package."), kind), snippet=F.concat_ws(" ", "package", F.coalesce("version", F.lit("?"))), detail=F.create_map(F.lit("package_manager"), kind))


def from_handshakes(df: DataFrame) -> DataFrame:
    """The sightings of handshakes (target_id, endpoint, version, suite): the protocol, and the algorithms of the suite."""
    number = F.coalesce(F.nullif(F.replace(F.col("version"), F.lit("TLSv"), F.lit("")), F.lit("")), F.lit("unknown"))
    entries = F.filter(F.array(F.struct(F.lit("version").alias("key"), number.alias("value")), F.struct(F.lit("protocol").alias("key"), F.lit("TLS").alias("value")), F.struct(F.lit("cipher_suite").alias("key"), F.col("suite").alias("value"))), lambda e: e["value"].isNotNull())
    place = {"endpoint": F.col("endpoint"), "path": F.lit(None).cast("string")}
    protocol = _row(df, "protocol", "tls", name=F.concat(F.lit("TLS"), number), primitive=F.lit("other"), parameters=F.map_from_entries(entries), tier=F.lit("negotiated"), matcher=F.lit("tls.handshake"), snippet=F.concat_ws(" ", F.coalesce("version", F.lit("None")), F.coalesce("suite", F.lit("None"))), detail=F.map_from_entries(F.filter(F.array(F.struct(F.lit("cipher_suite").alias("key"), F.col("suite").alias("value"))), lambda e: e["value"].isNotNull())), **place)
    parts = df.select("target_id", "endpoint", "suite", F.explode(detection.suite_parts(F.col("suite"))).alias("raw")).withColumn("tier", F.lit("negotiated"))
    parts = _resolved(parts, F.create_map().cast("map<string,string>"), F.array().cast("array<struct<k:string,v:string>>"), F.array().cast("array<string>"))
    return protocol.unionByName(_row(parts, "algorithm", "tls", name=F.col("asset_name"), primitive=F.col("primitive"), parameters=F.col("parameters"), oid=F.col("oid"), tier=F.col("tier"), matcher=F.concat(F.lit("tls.suite."), F.lower("raw")), snippet=F.col("suite"), **place))
