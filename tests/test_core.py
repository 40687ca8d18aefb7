import json
import struct
import tarfile
from datetime import datetime
from io import BytesIO

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators import assets, canonical, detection, hotkeys, identity, inventory, risk, sightings, snapshots
from keelson.functions.dims import PREFIX as P
from keelson.plans import outputs
from keelson.sources import binaries, journal, tables
from keelson.streaming import confidence

SPELLINGS = [
    ("EVP_aes_256_gcm", {"mode": "gcm", "key_size": "256"}, "AES-256-GCM", "AES"), ("sha256WithRSAEncryption", {}, "RSA", "RSA"), ("Kyber", {}, "ML-KEM-768", "ML-KEM"), ("SHA-256", {}, "SHA-256", "SHA-2"),
    ("prime256v1", {}, "ECDSA-P-256", "ECDSA"), ("TLS1.2", {}, None, None), ("certificate:CN=a.sha.example", {}, "SHA-1", "SHA-1"), ("AES", {}, "AES", "AES"), ("sphincs+", {}, "SLH-DSA-128", "SLH-DSA"), ("HmacSHA256", {}, None, None), ("", {}, None, None), (None, None, None, None),
]


def test_spellings(spark):
    df = spark.createDataFrame([(n, p) for n, p, _, _ in SPELLINGS], "name string, parameters map<string,string>")
    got = {r["name"]: (r["canonical_name"], r["family"]) for r in canonical.canonicalised(df).collect()}
    assert got == {n: (c, f) for n, _, c, f in SPELLINGS}


def test_strength(spark):
    df = spark.createDataFrame([("AES", {"key_size": k} if k else {}) for k in (None, "128", "256")] + [("RSA", {"key_size": "2048"})], "name string, parameters map<string,string>")
    got = [(r["quantum_bits"], r["quantum_status"], r["security_bits"]) for r in canonical.canonicalised(df).collect()]
    assert got == [(0, "weakened", 0), (64, "weakened", 128), (128, "safe", 256), (0, "broken", 112)]


def sighting(seq, tier="direct_api_call", matcher="m", snippet="s", target="t", name="AES", run="r", **kw):
    base = {
        "seq": seq, "run_id": run, "bom_ref": None, "target_id": target, "asset_kind": "algorithm", "name": name, "primitive": "block-cipher", "parameters": {}, "oid": None, "functions": ["encrypt"], "library": None,
        "collector": "source_ast", "confidence": 0.5, "location": ("source", f"f{seq}.c", 1, None, None, None), "evidence": [(tier, matcher, snippet, {})] if tier else None, "observed_at": datetime(2026, 1, 1),
    }
    return {**base, **kw}


SCHEMA = journal.SIGHTING.replace("run_id string,", "run_id string, bom_ref string,")


def frame(spark, rows):
    names = [f.name for f in T.StructType.fromDDL(SCHEMA)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def test_noisy_or(spark):
    rows = [sighting(1), sighting(2, "crypto_constant"), sighting(3), sighting(4, "nonsense"), sighting(5, None, name="MD5")]
    got = {r["name"]: (r["confidence"], r["n_evidence"], r["sightings"]) for r in assets.merged(frame(spark, rows)).collect()}
    assert got == {"AES": (0.985, 2, 4), "MD5": (0.0, 0, 1)}


def test_merge_does_not_depend_on_order(spark):
    rows = [sighting(i, t, f"m{i % 3}", library=lib, parameters={"issuer": f"v{i}"}, target=None if i % 5 == 0 else "t") for i, (t, lib) in enumerate([("negotiated", ""), ("string_literal", "b"), (None, None), ("direct_api_call", "c")] * 4)]
    a = assets.merged(frame(spark, rows)).orderBy("asset_ref").toPandas()
    b = assets.merged(frame(spark, rows[::-1]).repartition(5)).orderBy("asset_ref").toPandas()
    assert a.astype(str).equals(b.astype(str)) and len(a) == 2
    assert assets.merged(frame(spark, [])).count() == 0


def test_reference_is_ascii_json(spark):
    df = spark.createDataFrame([("repo-a", "algorithm", 'R"é\U0001f511\\', {"key_size": "2048", "issuer": "x", "mode": None}), (None, "library", None, None)], "t string, k string, n string, p map<string,string>")
    got = [r[0] for r in df.select(identity.canonical_key(F.col("t"), F.col("k"), F.col("n"), F.col("p"))).collect()]
    assert got[0] == json.dumps(["repo-a", "algorithm", 'R"é\U0001f511\\', [["key_size", "2048"]]], separators=(",", ":")) and got[1] == '[null,"library",null,[]]'


def test_mosca_bounds_and_ranks(spark):
    rows = [sighting(i, name=n, target=f"t{i}") for i, n in enumerate(("RSA", "RSA", "MD5", "SHA-256", "odd", "AES-128"))]
    a = risk.assessed(assets.merged(frame(spark, rows)), spark.createDataFrame([("t0", "critical"), ("t1", "low"), ("t5", "medium")], "target_id string, criticality string"))
    got = {(r["name"], r["target_id"]): (r["tier"], r["tripped"]) for r in a.collect()}
    assert got == {("RSA", "t0"): ("critical", 3), ("RSA", "t1"): ("low", 0), ("MD5", "t2"): ("critical", 2), ("SHA-256", "t3"): ("pq-safe", None), ("odd", "t4"): ("medium", None), ("AES-128", "t5"): ("medium", 1)}
    q = risk.ranked(risk.queue(a)).orderBy("rank").collect()
    assert [r["rank"] for r in q] == [1, 2, 3, 4, 5, 6] and q[0]["name"] == "RSA" and q[-1]["tier"] == "pq-safe"
    assert {r["name"]: r["recommended"] for r in q} == {"RSA": "ML-KEM-768", "MD5": "SHA-256", "SHA-256": None, "odd": None, "AES-128": "AES-256"}


def test_hot_keys(spark):
    rows = [("hot", "r", f"b{i % 7}", i) for i in range(900)] + [(f"k{i}", "r", None, None) for i in range(99)] + [(None, "r", "b", 1)]
    df = spark.createDataFrame(rows, "name string, run_id string, bom_ref string, t long").withColumn("at", F.timestamp_micros("t")).withColumns({"key": F.lit("clash"), "field": F.lit(1), "p": F.lit(2)})
    got = {r["key_value"]: (r["sightings"], r["assets"], r["latest"]) for r in hotkeys.key_totals(df, ["name"], ["run_id", "bom_ref"], "at").collect()}
    assert got["hot"][:2] == (900, 7) and got["hot"][2].microsecond == 899 and got["k3"] == (1, 0, None) and len(got) == 100
    assert [tuple(r) for r in hotkeys.hot_keys(df, ["name"]).collect()] == [("name", "hot")]
    for blocks in (None, 1, 500):
        assert {tuple(r) for r in hotkeys.key_counts(df.repartition(7), ["name"], blocks).collect()} == {("name", "hot", 900), *(("name", f"k{i}", 1) for i in range(99))}
    assert hotkeys.key_counts(df.limit(0), ["name"]).count() == 0 == hotkeys.hot_keys(df.limit(0), ["name"]).count()
    many = spark.range(60_000).selectExpr("CAST(id % 20000 AS STRING) AS name")
    assert hotkeys._n_blocks(many, ["name"]) >= 8 and hotkeys.key_counts(many, ["name"]).filter("sightings = 3").count() == 20_000
    assert hotkeys.key_totals(df.limit(0), ["name"], ["run_id", "bom_ref"], "at").count() == 0


def test_snapshots(spark):
    day = datetime(2026, 1, 1)
    rows = [
        (1, day, "aaaaaaaaaaaaaaaa", {P + "confidence": "0.9", P + "surfaces": "tls,elf"}), (1, day, "bbbbbbbbbbbbbbbb", None), (1, day, "cccccccccccccccc", {P + "quantum-status": "safe"}),
        (2, day, " AAAAAAAAAAAAAAAA", {P + "confidence": "9.0e-1", P + "surfaces": "elf; tls", P + "location": "x"}), (2, day, "urn:cbom:cccccccccccccccc", {P + "quantum-status": "safe"}),
        (2, datetime(2026, 2, 1), "cccccccccccccccc", {}), (2, day, "dddddddddddddddd", {}), (2, day, None, {}), (2, day, "short", {}), (4, day, "eeeeeeeeeeeeeeee", {}),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows * 2], "snapshot_no int, delivered_at timestamp, bom_ref string, properties map<string,string>, confidence string")
    got = {(r["snapshot_no"], r["bom_ref"][0], r["change_kind"]): [tuple(c) for c in r["changes"]] for r in snapshots.snapshot_changes(df).collect()}
    assert got == {(2, "b", "removed"): [], (2, "c", "changed"): [("quantum-status", "safe", None)], (2, "d", "added"): []}
    assert snapshots.snapshot_changes(df.limit(0)).count() == 0


def test_detection(spark):
    c = b'#include <openssl/evp.h>\n/* EVP_md5(x) */ int f(void) { g("EVP_rc4()"); return EVP_sha256() != EVP_sha256(); } // EVP_rc4()\n'
    go = b'import (\n\t"crypto/md5"\n)\nfunc f() { md5.New(); rsa.GenerateKey(r, 2048) }\n'
    df = spark.createDataFrame([(1, "t", "a.C", c), (2, "t", "b.go", go), (3, "t", "x.txt", c), (4, None, None, None)], "file_id long, target_id string, path string, content binary")
    assert sorted((r["file_id"], r["call"], r["hits"]) for r in detection.calls(df).collect()) == [(1, "EVP_sha256", 2), (2, "md5.New", 1), (2, "rsa.GenerateKey", 1)]
    assert sorted((r["file_id"], r["library"]) for r in detection.includes(df).collect()) == [(1, "openssl"), (2, "crypto/md5")]
    s = spark.createDataFrame([("ECDHE-RSA-AES256-SHA384",), ("TLS_AES_256_GCM_SHA384",), (None,)], "s string")
    assert [r[0] for r in s.select(detection.suite_parts(F.col("s"))).collect()] == [["ECDH", "AES-256-CBC"], ["AES-256-GCM", "SHA-384"], None]
    t = spark.createDataFrame([("x.example:443",), ("[::1]:8443",), ("a:0",), ("img.tar.GZ",), ("a:70000",), ("plain",)], "s string")
    assert [r[0] for r in t.select(detection.target_kind(F.col("s"))).collect()] == ["endpoint", "endpoint", "unknown", "container", "unknown", "unknown"]


def test_journal(spark, tmp_path):
    rows = frame(spark, [sighting(1), sighting(2)]).drop("bom_ref")
    journal.write_sightings(rows, str(tmp_path))
    (tmp_path / "findings" / "broken.json").write_text('\n{"seq": 3, "target_id": "t"\n{"seq": 4, "target_id": "t"}\n{"seq": 5, "asset_kind": "odd", "target_id": "t", "name": "n", "collector": "c", "location": {"surface": "source"}}\n')
    assert sorted(r["seq"] for r in journal.replay(spark, str(tmp_path)).collect()) == [1, 2]
    q = confidence.running_confidence(journal.tail(spark, str(tmp_path))).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["confidence"], r["n_evidence"]) for r in spark.table("running").collect()] == [(0.95, 1)]
    targets = spark.createDataFrame([("t", "h1"), ("u", "h2")], "target_id string, content_hash string")
    m = journal.manifest(targets, rows, spark.createDataFrame([("u",)], "target_id string"))
    assert sorted(tuple(r) for r in m.collect()) == [("t", "h1", "complete", 2, 0), ("u", "h2", "error", 0, 1)]
    assert [r["target_id"] for r in journal.to_scan(targets, m).collect()] == ["u"]
    assert journal.upserted(m, m.filter("target_id = 'u'").withColumn("status", F.lit("complete"))).filter("status = 'complete'").count() == 2


def elf(needed=b"libcrypto.so.3", symbol=b"EVP_sha256", data=bytes.fromhex("00637c777bf26b6fc53001672bfed7ab76")):
    strings = b"\0" + needed + b"\0" + symbol + b"\0malloc\0"
    dynamic = struct.pack("<qQqQ", 1, 1, 0, 0)
    syms = b"\0" * 24 + struct.pack("<I20x", 2 + len(needed)) + struct.pack("<I20x", 3 + len(needed) + len(symbol))
    names = b"\0.dynstr\0.dynamic\0.dynsym\0.rodata\0.shstrtab\0"
    bodies, at, out = [strings, dynamic, syms, data, names], 64, []
    for b in bodies:
        out.append(at)
        at += len(b)
    head = lambda name, kind, addr, i, link: struct.pack("<IIQQQQIIQQ", names.find(name), kind, 0, addr, out[i], len(bodies[i]), link, 0, 0, 0)
    table = b"\0" * 64 + head(b".dynstr", 3, 0, 0, 0) + head(b".dynamic", 6, 0, 1, 1) + head(b".dynsym", 11, 0, 2, 1) + head(b".rodata", 1, 0x1000, 3, 0) + head(b".shstrtab", 3, 0, 4, 0)
    return b"\x7fELF\x02\x01\x01" + b"\0" * 33 + struct.pack("<Q", at) + b"\0" * 10 + struct.pack("<HHH", 64, 6, 5) + b"".join(bodies) + table


def tar(**members):
    buf = BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for name, content in members.items():
            info = tarfile.TarInfo(name.replace("__", "/"))
            info.size = len(content)
            t.addfile(info, BytesIO(content))
    return buf.getvalue()


def test_binaries(spark):
    assert binaries.facts(elf()) == [("needed", "libcrypto.so.3", "", 0), ("symbol", "EVP_sha256", "SHA-2", 0), ("constant", "const.aes.sbox", "AES", 0x1001)]
    layer = tar(usr__bin__d=elf(), etc__motd=b"hi", var__lib__dpkg__status=b"Package: openssl\nVersion: 1\n")
    image = tar(**{"manifest.json": b'[{"Layers": ["layer.tar", "gone.tar"]}]', "layer.tar": layer})
    df = spark.createDataFrame([("i", image), ("j", b"no tar"), ("k", None)], "target_id string, content binary")
    got = binaries.image_members(df)
    assert sorted((r["target_id"], r["path"] or "", (r["error"] or "")[:11]) for r in got.collect()) == [("i", "", "layer missi"), ("i", "usr/bin/d", ""), ("i", "var/lib/dpkg/status", ""), ("j", "", "cannot open")]
    found = binaries.elf_facts(got.filter("path IS NOT NULL"))
    assert found.count() == 3 and found.filter("layer_digest = 'layer.tar'").count() == 3
    broken = spark.createDataFrame([("t", "p", elf()[:100]), ("t", "q", b"text")], "target_id string, path string, content binary")
    assert [r["error"] is not None for r in binaries.elf_facts(broken).collect()] == [True]


def test_outputs(spark, tmp_path):
    a = assets.merged(frame(spark, [sighting(1), sighting(2, "filename_metadata", name="MD5"), sighting(3, name="RSA", run="q")]))
    for i in (1, 2):
        outputs.bill_of_materials(a, "r", str(tmp_path / f"b{i}.json"))
    assert (tmp_path / "b1.json").read_bytes() == (tmp_path / "b2.json").read_bytes()
    doc = json.loads((tmp_path / "b1.json").read_text())
    assert doc["specVersion"] == "1.7" and [c["name"] for c in doc["components"]] == ["AES"]
    assert outputs.load_components(spark, str(tmp_path / "b1.json")).first()["properties"][P + "quantum-status"] == "weakened"
    errors = spark.createDataFrame([(1, "t", "parse", "bad", None)], "error_id long, target_id string, phase string, reason string, reported_at timestamp")
    outputs.report(risk.queue(risk.assessed(a)), errors, str(tmp_path / "r.md"))
    assert "| 1 |" in (tmp_path / "r.md").read_text()
    outputs.evidence_pack(str(tmp_path), str(tmp_path / "p.zip"))
    assert inventory.components(a, include_low=True).count() == 3


def test_bill_has_every_location_and_matcher(spark, tmp_path):
    at = lambda *x: ("source", *x, None, None)
    rows = [sighting(1, "string_literal", "z", location=at("b.c", 1, None)), sighting(2, "direct_api_call", "m", location=at("c.c", 1, None)), sighting(3, "nonsense", "x", location=("elf", "z", None, 16, None, None)), sighting(4, location=at("b.c", 1, None))]
    rows += [sighting(5, location=at("b.c", 1, 7)), sighting(6, location=None)]  # 5 differs from 1 in its offset only
    outputs.bill_of_materials(assets.merged(frame(spark, rows)), "r", str(tmp_path / "b.json"))
    (c,) = json.loads((tmp_path / "b.json").read_text())["components"]
    p = {x["name"].removeprefix(P): x["value"] for x in c["properties"]}
    assert {k: v for k, v in p.items() if k.startswith("location")} == {"location.0": "z@0x10", "location.1": "b.c:1", "location.2": "b.c:1", "location.3": "c.c:1"}
    assert p["matchers"] == "m,z" and c["description"] == "<unknown>" and len(p) == len(c["properties"])


def test_whole_bags_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from keelson.plans import registry

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW findings AS SELECT * FROM read_parquet('{d}/findings.parquet')")
    want = con.execute(registry.ORACLE["cbom_bag"])
    cols = [c[0] for c in want.description]
    got = [tuple(r) for r in registry.QUERIES["cbom_bag"](spark, str(d)).select(*cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall())) and any(r[4].endswith("location.1") for r in got)


def test_suites_and_packages_of_tables_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from keelson.plans import inventory as plans
    from keelson.plans import registry

    names = [*plans._SUITES, None, "", "tls_rsa_with_aes_128_cbc_sha", "AES-128"]
    spark.createDataFrame(list(enumerate(names)), "seq bigint, name string").write.parquet(str(tmp_path / "findings.parquet"))
    spark.createDataFrame([(1, plans._STATUS), (2, None), (3, "no package"), (4, "V:1\nP:openssl-dev\n\n\nPackage:  openssl \nVersion:\n")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("findings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = {}
    for name in ("det_suite_names", "src_package_texts"):
        want = con.execute(registry.ORACLE[name])
        cols = [c[0] for c in want.description]
        got[name] = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*cols).collect()]
        assert sorted(map(str, got[name])) == sorted(map(str, want.fetchall())), name
    fixed = [(names[i], p, a) for i, p, a in got["det_suite_names"] if i < len(plans._SUITES)]
    assert sorted(fixed) == sorted(con.execute(registry.ORACLE["det_suites"]).fetchall())
    assert {x for x in got["src_package_texts"] if x[0] != 1} == {(4, "openssl-dev", "1"), (4, "openssl", None)} and sum(x[0] == 1 for x in got["src_package_texts"]) == 3


def test_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from keelson.plans import registry

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in d.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name in ("p3_found", "p3_key_totals", "p5_found", "p5_changes", "prj_bom_ref", "fn_canonicalise", "agg_merge", "srt_queue", "cbom_properties", "set_common"):
        want = con.execute(registry.ORACLE[name])
        cols = [c[0] for c in want.description]
        rows = sorted(map(str, want.fetchall()))
        got = sorted(str(tuple(r)) for r in registry.QUERIES[name](spark, str(d)).select(*cols).collect())
        assert got == rows, name


SOURCES = {
    "a.c": '#include <openssl/evp.h>\n#define M EVP_md5()\n// EVP_rc4()\nvoid HMAC(int a);\nint f(void) {\n  g("EVP_sha1()");\n  RSA_generate_key_ex(r, 2048u, e, 0);\n  RSA_generate_key_ex(r, bits, e, 0);\n  EC_KEY_new_by_curve_name(NID_secp384r1);\n  return EVP_aes_256_gcm (\n);\n}\n',
    "B.java": 'import javax.crypto.Cipher;\nclass B { void f(String s) { javax.crypto.Cipher.getInstance("AES/GCM/NoPadding"); Cipher.getInstance(s); KeyStore.getInstance(s); Mac.getInstance("HmacSHA256"); other.getInstance("DES"); } }\n',
    "c.go": 'package a\nimport (\n\t"crypto/rsa"\n\t"fmt"\n)\nfunc f() { rsa.GenerateKey(rand.Reader, 4096); x.GenerateKey(a, 1); elliptic.P256() }\n',
    "d.txt": "EVP_md5()",
    "e.cc": "auto x = my::seal(1);\n",
}


def test_sightings_of_sources(spark):
    rows = [(i, "t", p, c.encode(), "clash") for i, (p, c) in enumerate(SOURCES.items())] + [(9, "t", "n.c", None, ""), (10, None, "x.go", b"\xff\xfe", ""), (11, "t", None, b"", "")]
    files = spark.createDataFrame(rows, "file_id bigint, target_id string, path string, content binary, name string")
    own = spark.createDataFrame([("cpp", 0, "own.seal", "seal", "my", "Kyber", {"key_size": "1024"}, ["encapsulate", "nonsense"], "mine", None, None, False), ("c", 1, "none", None, None, None, None, None, None, None, None, None)], sightings.RULE)
    got = sightings.from_sources(files, sightings.rules(spark, own)).select("location.path", "location.line", "name", F.col("evidence")[0]["tier"], "parameters", "functions").collect()
    assert sorted((p, n, name, tier) for p, n, name, tier, _, _ in got) == [
        ("B.java", 1, "jca", "linked_library_unpinned"), ("B.java", 2, "AES-GCM", "direct_api_call"), ("B.java", 2, "HmacSHA256", "string_literal"), ("B.java", 2, "jca", "string_literal"),
        ("a.c", 1, "openssl", "linked_library_unpinned"), ("a.c", 7, "RSA-2048", "direct_api_call"), ("a.c", 8, "RSA", "linked_library_pinned"), ("a.c", 9, "ECDSA-P-384", "direct_api_call"), ("a.c", 10, "AES-256-GCM", "direct_api_call"),
        ("c.go", 3, "crypto/rsa", "linked_library_unpinned"), ("c.go", 6, "ECDSA-P-256", "direct_api_call"), ("c.go", 6, "RSA-4096", "direct_api_call"), ("e.cc", 1, "ML-KEM-1024", "direct_api_call"),
    ]
    assert [(p["key_size"], f) for _, _, n, _, p, f in got if n == "ML-KEM-1024"] == [("1024", ["encapsulate"])]
    assert [tuple(r) for r in sightings.source_errors(files).collect()] == [("t", "source_ast", "read", "no content", "n.c")]
    assert sightings.from_sources(files.limit(0)).count() == 0
    merged = assets.merged(sightings.from_sources(files).withColumns({"seq": F.monotonically_increasing_id(), "run_id": F.lit("r"), "observed_at": F.lit(None).cast("timestamp")}))
    assert {r["name"]: r["confidence"] for r in merged.collect()}["RSA-4096"] == 0.95


def test_sightings_of_handshakes_packages_and_binaries(spark):
    h = spark.createDataFrame([("t", "h:443", "TLSv1.3", "TLS_AES_256_GCM_SHA384"), ("t", "h:1", None, None)], "target_id string, endpoint string, version string, suite string")
    got = {(r["asset_kind"], r["name"]) for r in sightings.from_handshakes(h).collect()}
    assert got == {("protocol", "TLS1.3"), ("protocol", "TLSunknown"), ("algorithm", "AES"), ("algorithm", "SHA-384")} or ("algorithm", "AES-256") in got
    p = spark.createDataFrame([("i", "openssl", "3.0", "sha256:a"), ("i", "libssl3", None, None)], "target_id string, package string, version string, layer_digest string")
    assert [(r["name"], r["confidence"], r["location"]["path"]) for r in sightings.from_packages(p, F.lit("dpkg")).collect()] == [("openssl", 0.3, "dpkg package database"), ("libssl3", 0.3, "dpkg package database")]
    facts = spark.createDataFrame([("t", "b", None, "needed", "libcrypto.so.3", "", 0, None), ("t", "b", None, "needed", "libc.so.6", "", 0, None), ("t", "b", None, "symbol", "EVP_sha256", "SHA-2", 0, None), ("t", "b", None, "constant", "const.aes.sbox", "AES", 4096, None), ("t", "b", None, None, None, None, None, "bad")], binaries._FACTS)
    assert {(r["name"], r["confidence"], r["location"]["byte_offset"]) for r in sightings.from_binaries(facts).collect()} == {("openssl", 0.55, None), ("SHA-256", 0.8, None), ("AES", 0.7, 4096)}


def test_serial_is_the_digest_of_all_references(spark):
    import hashlib
    import uuid

    refs = [f"{i:016x}" for i in range(5000)]
    comps = spark.createDataFrame([("a", r) for r in refs[::-1]] + [(None, "x"), ("b", "y")], "run_id string, bom_ref string").repartition(7)
    want = lambda s: uuid.UUID(bytes=hashlib.sha256(s.encode()).digest()[:16], version=4).urn
    assert {r["run_id"]: r["serial"] for r in inventory.serial(comps).collect()} == {"a": want("".join(refs)), None: want("x"), "b": want("y")}


def test_names_resolved_once_are_the_same(spark):
    df = spark.createDataFrame([(n, p, "clash") for n, p, _, _ in SPELLINGS] * 2 + [("RSA", None, "")], "name string, parameters map<string,string>, family string")
    a, b = canonical.canonicalised(df).drop("parameters"), canonical.canonicalised_once(df).drop("parameters")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_recommendations_in_full(spark):
    a = risk.assessed(assets.merged(frame(spark, [sighting(1, name="RSA-2048", functions=["sign"]), sighting(2, name="MD5", functions=["digest"]), sighting(3, name="SHA-256")])))
    got = {r["name"]: r for r in risk.detailed(risk.queue(a)).withColumn("why", risk.reason()).collect()}
    r = got["RSA-2048"]
    assert (r["recommended"], r["standard"], r["headline"]["field"], r["headline"]["delta"], r["headline"]["ratio"]) == ("ML-DSA-65", "FIPS 204", "signature", 3053, 12.9)
    assert got["MD5"]["standard"] == "FIPS 180-4" and got["SHA-256"]["standard"] is None and got["SHA-256"]["why"].startswith("Not quantum")


def test_split_sizes_in_any_unit(spark, tmp_path):
    spark.range(200_000).select((F.rand(1) * 1e9).alias("x")).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        got = {}
        for size in ("16m", "1g", "16777216b", "64k", "65536"):
            spark.conf.set(key, size)
            df = tables.table(spark, str(tmp_path), "t")
            got[size] = df.rdd.getNumPartitions()
            assert df.count() == 200_000
    finally:
        spark.conf.set(key, before)
    # few splits are spread over the 8 cores; many are left as they are
    assert got["16m"] == got["1g"] == got["16777216b"] == 8
    assert got["64k"] == got["65536"] > 8


def test_hot_keys_with_split_sizes_in_megabytes(spark):
    from pathlib import Path

    from keelson.plans import registry

    d = Path("/root/testdata/sf0.01")
    if not d.exists():
        pytest.skip("no test tables")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    want = sorted(map(str, registry.QUERIES["p3_found"](spark, str(d)).collect()))
    try:
        spark.conf.set(key, "16m")
        got = sorted(map(str, registry.QUERIES["p3_found"](spark, str(d)).collect()))
    finally:
        spark.conf.set(key, before)
    assert got == want != []
