import json
import random
import re
import string
import time
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import grammars, lexers, packing, registry, sentences, spellings, survivors, syntax, tokens

LOC = "struct<surface:string,path:string,line:int,byte_offset:bigint,layer_digest:string,endpoint:string>"
EV = "array<struct<tier:string,matcher_id:string,snippet:string,detail:map<string,string>>>"
FINDING = f"seq bigint, run_id string, bom_ref string, collector string, confidence double, location {LOC}, evidence {EV}, parameters map<string,string>, observed_at timestamp, n_rows int, locations string"
TIERS = [("negotiated", 7), ("string_literal", 2), (None, None)]


def found(spark, rows):
    f = spark.createDataFrame([(*r, 1, "clash") for r in rows], FINDING)
    t = spark.createDataFrame(TIERS, "tier string, strength int")
    return f, t


def at(day):
    return datetime(2026, 1, day)


ROWS = [
    (1, "r", "a", "elf", 0.5, ("elf", "x", 1, None, None, None), [("string_literal", "m", None, None)], {"k": "1", "l": "n/a"}, at(1)),
    (2, "r", "a", "tls", float("nan"), ("tls", "--", None, None, None, "?:?"), [("negotiated", "m", None, None), None], {"k": "1", "l": "2"}, at(1)),
    (3, "r", "a", "elf", 1.0, None, [("negotiated", "TBD", None, None)], None, at(9)),
    (4, "r", "a", "elf", 0.5, ("elf", "x", 1, None, None, None), [("string_literal", "m", None, None)], {"k": "1", "l": "n/a"}, at(1)),
    (5, "r", "b", "elf", 0.5, ("elf", "x", 1, None, None, None), None, None, at(1)),
    (6, "r", None, "elf", 0.5, ("elf", "x", 1, None, None, None), None, None, at(1)),
    (7, "r", "c", "tls", -1.0, None, None, {}, None),
    (8, "r", "c", "tls", None, ("tls", " ", 0, 0, "", "h:443"), [], {"a": None}, None),
]


def test_survivors(spark):
    got = sorted(tuple(r) for r in survivors.found(*found(spark, ROWS)).collect())
    assert got == [("r", "a", "confidence", 1), ("r", "a", "evidence", 2), ("r", "a", "locations", 1), ("r", "a", "parameters", 2), ("r", "c", "locations", 8)]
    f, t = found(spark, ROWS)
    assert survivors.found(f.limit(0), t).count() == 0


def test_branch_and_bound_against_all_records(spark):
    rng = random.Random(5)
    for _ in range(200):
        n = 3
        slots = [[0], [0, 1], [1]]
        cands = [sorted(((rng.randint(0, 7), i, [rng.choice("xy") if rng.random() < 0.9 else None for _ in slots[b]]) for i in range(rng.randint(0, 4))), reverse=True, key=lambda c: (c[0], -c[1])) for b in range(n)]
        best = None
        options = [[*range(len(c)), None] for c in cands]
        for a in options[0]:
            for b in options[1]:
                for c in options[2]:
                    pick, held, ok = (a, b, c), {}, True
                    for s, p, own in zip(slots, pick, cands):
                        if p is not None:
                            for j, v in zip(s, own[p][2]):
                                if v is not None and held.setdefault(j, v) != v:
                                    ok = False
                    if ok:
                        ranks = [p if p is not None else len(own) for p, own in zip(pick, cands)]
                        value = (sum(p is not None for p in pick), sum(own[p][0] for p, own in zip(pick, cands) if p is not None), [-r for r in ranks])
                        if best is None or value > best[0]:
                            best = (value, [None if p is None else own[p][1] for p, own in zip(pick, cands)])
        got = survivors.search([[c[1] for c in own] for own in cands], [[float(c[0]) for c in own] for own in cands], [[c[2] for c in own] for own in cands], slots)
        assert got == best[1]


def test_records_are_consistent(spark):
    rows = [
        (1, "r", "a", "elf", 0.9, ("elf", "x", 1, None, None, None), [("string_literal", "m", None, None)], {"k": "1"}, at(1)),
        (2, "r", "a", "tls", 0.8, None, [("negotiated", "m", None, None)], {"k": "1"}, at(1)),
        (3, "r", "a", "tls", 0.7, ("tls", None, None, None, None, "h:443"), [("string_literal", "m", None, None)], None, at(1)),
    ]
    got = survivors.records(*found(spark, rows)).collect()
    # the location of row 3 fits the evidence and the confidence of row 2, which outweighs row 1
    assert [(r["locations_seq"], r["evidence_seq"], r["confidence_seq"], r["parameters_seq"]) for r in got] == [(3, 2, 2, 2)]


ALGS = [(1, "algorithm", "AES", "AES", "block-cipher", None, None, None), (2, "algorithm", "AES-256", "AES", "block-cipher", 256, None, None), (3, "algorithm", "AES-256-GCM", "AES", "block-cipher", 256, None, "gcm"),
        (4, "algorithm", "DH-2048", "DH", "key-agree", 2048, None, None), (5, "algorithm", "ECDH-P-256", "ECDH", "key-agree", None, "P-256", None), (6, "algorithm", "ECDH", "ECDH", "key-agree", None, None, None), (7, "curve", "P-256", None, None, None, "P-256", None)]
ALIAS = [("Rijndael", "algorithm", "AES"), ("prime256v1", "curve", "P-256")]


def listed(spark):
    a = spark.createDataFrame(ALGS, "entry_id int, entry_kind string, name string, family string, primitive string, key_size int, curve string, mode string")
    return a, spark.createDataFrame(ALIAS, "alias string, entry_kind string, canonical string")


def test_spellings(spark):
    a, b = listed(spark)
    cases = [("aes_256_gcm", {}, 3), ("АЕЅ-256-GСM", {}, 3), ("GCM mode AES 256", {}, 3), ("aes", {"key_size": "256", "mode": "gcm"}, 3), ("AES-512", {}, -1), ("uses aees-256", {}, 2), ("aes-256-gmc?", {}, 3), ("Rijndael-256", {"mode": "n/a"}, 2),
             ("ecdh prime256v1", {}, 5), ("ecdh", {"curve": "NIST P-256"}, 5), ("", {}, -1), ("?", {}, -1), ("x" * 3000, {}, -1), ("RSA 2k", {}, -1), ("dh (2k)", {}, 4)]
    f = spark.createDataFrame([(i, "algorithm", n, p, "unknown") for i, (n, p, _) in enumerate(cases)] + [(90, "algorithm", None, None, None), (91, "algorithm", "AES", {"curve": "p_256"}, None), (92, "library", "aes", None, None)], "seq bigint, asset_kind string, name string, parameters map<string,string>, primitive string")
    rules = spark.createDataFrame([(7, "aes 256", {}), (8, None, None)], "rule_id bigint, algorithm string, parameters map<string,string>")
    got = {(r["table_name"], r["row_key"], r["field"]): r["entry_id"] for r in spellings.mapped(spark, f, rules, a, b).collect()}
    want = {("findings", i, "name"): e for i, (_, _, e) in enumerate(cases)} | {("findings", 9, "curve"): 7, ("findings", 91, "curve"): 7, ("source_rules", 7, "algorithm"): 2}
    assert got == want
    assert spellings.mapped(spark, f.limit(0), rules.limit(0), a, b).count() == 0


WRAPPED = [
    ("we rely on AES-256-GCM", 3), ("AES-256-GCM (per audit)", 3), ("RSA-2048 cert", 11), ("firmware uses RSA 2048", 11), ("Ed25519 host keys", 12), ("SHA256 fingerprint", 14), ("ML-KEM-768 hybrid", 15), ("ECDH over P-256", 5),
    ("ChaCha20 vpn", 16), ("AEX-256-GCN", 3), ("AES-256-QRX", -1), ("backup AES 256 QRX", -1), ("tunnel AES 512", -1), ("RSA with SHA256", -1), ("firmware uses GCMM AES 256", 3), ("rely on Rijndael for the tunnel", 1), ("notes only", -1), ("word " * 3000 + "AES-256", 2),
]


def test_words_around_a_name_do_not_matter(spark):
    a, b = listed(spark)
    more = [(11, "algorithm", "RSA-2048", "RSA", "pke", 2048, None, None), (12, "algorithm", "EdDSA-Ed25519", "EdDSA", "signature", None, "Ed25519", None), (13, "curve", "Ed25519", None, None, None, "Ed25519", None),
            (14, "algorithm", "SHA-256", "SHA", "hash", 256, None, None), (15, "algorithm", "ML-KEM-768", "ML-KEM", "kem", 768, None, None), (16, "algorithm", "ChaCha20", "ChaCha20", "stream-cipher", None, None, None)]
    a = a.unionByName(spark.createDataFrame(more, a.schema))
    b = b.unionByName(spark.createDataFrame([("ed25519", "algorithm", "EdDSA-Ed25519")], b.schema))
    f = spark.createDataFrame([(i, "algorithm", v, {}, None) for i, (v, _) in enumerate(WRAPPED)], "seq bigint, asset_kind string, name string, parameters map<string,string>, primitive string")
    rules = spark.createDataFrame([], "rule_id bigint, algorithm string, parameters map<string,string>")
    got = {r["row_key"]: r["entry_id"] for r in spellings.mapped(spark, f, rules, a, b).collect()}
    assert {WRAPPED[i][0][-30:]: e for i, e in got.items()} == {v[-30:]: e for v, e in WRAPPED}


def test_spellings_of_rows_without_a_key(spark):
    a, b = listed(spark)
    f = spark.createDataFrame([(None, "algorithm", "aes_256_gcm", {}, None), (-1, "algorithm", "aes_256_gcm", {}, None)], "seq bigint, asset_kind string, name string, parameters map<string,string>, primitive string")
    rules = spark.createDataFrame([(None, "aes 256", {})], "rule_id bigint, algorithm string, parameters map<string,string>")
    got = spellings.mapped(spark, f, rules, a, b).collect()
    assert {tuple(r) for r in got} == {("findings", None, "name", 3), ("findings", -1, "name", 3), ("source_rules", None, "algorithm", 2)} and len(got) == 3


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_pigeonhole_join_against_all_pairs(spark):
    rng = random.Random(3)
    refs = sorted({"".join(rng.choice("ab12") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    values = sorted({"".join(rng.choice("ab12") for _ in range(rng.randint(0, 10))) for _ in range(150)} | {""})
    got = {(r["bare"], r["spelling"], r["distance"]) for r in spellings.match_values(spark, spark.createDataFrame([("k", v) for v in values], "kind string, bare string"), spark.createDataFrame([("k", r) for r in refs], "kind string, spelling string")).collect()}
    want = set()
    for v in filter(None, values):
        near = []
        for r in refs:
            if re.sub(r"\D", "", v) == re.sub(r"\D", "", r):
                d = distance(v, r)
                swap = len(v) == len(r) and any(v[: i] + v[i + 1] + v[i] + v[i + 2 :] == r for i in range(len(v) - 1))
                d = 1 if swap and d == 2 else d
                if d <= 1 or (d <= spellings.K and len(r) >= 4 * d):
                    near.append((r, d))
        want |= {(v, r, d) for r, d in near if d == min(x for _, x in near)}
    assert got == want


GOOD = {
    "c": ["", "int x;", "#define R(x) do { (x)++; } while (0)\nint f(int a){ R(a); return (int)a * sizeof(int); }", "#if 0\n<<<<<<< it's\n#endif\nstruct s { int a : 3; } v = { .a = 1 };", "#ifdef A\nint f(){ if (1) {\n#else\nint f(void){ if (2) {\n#endif\n;} }", "/* \xfc */ typedef unsigned char u8; u8 *g(const u8 *p, ...) { for (;;) { switch (*p) { case 1: break; default: goto out; } } out: return 0; }"],
    "cpp": ["", "namespace a { template <typename T> class B : public C<T> { public: B() : x_(1) {} T get() const { return static_cast<T>(x_); } private: int x_; }; }", 'auto s = R"x(\n)" )x"; int main() { auto f = [&](int k) { return k << 9; }; for (auto &v : m) f(v); std::vector<std::vector<int>> q{1, 2}; }'],
    "java": ["", "package a.b; import java.util.*; @A(x = 1) public final class C<T extends B> extends D implements E { int[] a = {1, 2}; C(int x) { super(x); } Map<String, List<Integer>> m() throws X { for (int i = 0; i < 3; i++) { Runnable r = () -> { f('{'); }; } return switch (k) { case 1, 2 -> 3; default -> throw new Y(); }; } }", 'record R(int a) { static final String S = """\n  "{ \\""" \n"""; } enum K { A, B { } ; int z; }'],
    "go": ["package a\n", 'package a\nimport (\n\t"x"\n)\ntype T struct {\n\tA []byte `j:"{"`\n}\nfunc (t *T) f(n int, s ...string) (int, error) {\n\tif _, err := g(T{1}); err != nil {\n\t\treturn 0, err\n\t}\n\tfor i := range s {\n\t\tgo func() { h(i) }()\n\t}\n\tswitch x := y.(type) {\n\tcase int, []T:\n\t\tx++\n\t}\n\treturn a + b, nil\n}\n'],
    "python": ["", "def f(x):\n    return f'{x}'\n"],
    "json": ['{"a": [1, -2.5e3, null]}'],
}
BAD = {
    "c": ["int f(int a){ return a }", "int x = 1 y = 2;", "void f(){ if (1) { }", "namespace a {}", "x += 1;", "#if 1\nint a;", "/* open", 'char *s = "a;\n";', "int f(){\n<<<<<<< a\n}", "int f(){}\n\0\0"],
    "cpp": ["class A { int f() { return 1 } };", "namespace a { int x;", "package a", 'auto s = R"(', "int f() { else; }"],
    "java": ["class A { void f() { a + b; } }", "class A { int f() { return 1 } }", "class A {", "int x;", 'class A { String s = "a; }', "class A { void f() { x = 1 y = 2; } }", "class A { }\n=======\n", 'class A { String s = """\n'],
    "go": ["", "func f() {}\n", "package a\nfunc f() {\n", "package a\nfunc f() { x = 1 y = 2 }\n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\nvar s = `x\n", "package a\nimport \"b\" func f() {}\n"],
    "python": ["print 'x'", "def f(:\n", "<<<<<<< a\n"],
    "json": ["", "{", "{'a': 1}", "[1,]", "NaN", '{"a":1}\n{"a":2}'],
}


LATER_GOOD = [
    ('cpp', 'template<class... T> void f(T... ts) { (g(ts), ...); }'),
    ('cpp', 'template<class... T> auto s(T... t) { return (t + ...); }'),
    ('cpp', 'template<class... T> bool a(T... t) { return (... && t); }'),
    ('cpp', 'template<class... T> int b(T... t) { return (0 + ... + t); }'),
    ('cpp', 'namespace a::b::inline c { int x; }'),
    ('cpp', 'export module m;\nexport int f();'),
    ('cpp', 'module;\n#include <x>\nexport module m.n;\nimport std;\nimport <vector>;\nexport { int g(); }\nexport namespace q { int z; }'),
    ('java', 'module a.b { requires transitive c.d; exports x.y to z; opens p.q; uses r.S; provides r.S with t.U; }'),
    ('java', 'import a.B;\n@Deprecated open module a { }'),
    ('c', 'int f(void) __attribute__((noreturn));'),
    ('c', 'void f(void) __asm__("g");'),
    ('cpp', 'void f() __attribute__((noreturn));'),
    ('c', 'int f(int a) __attribute__((unused)), g(void);'),
    ('c', 'extern int x __asm__("y") __attribute__((weak));'),
    ('c', 'int x __attribute__((aligned(8)));'),
    ('cpp', 'struct A { int f() const noexcept override final; void g() && = delete; auto h() -> int; };'),
    ('cpp', 'void A::f() const & noexcept {}'),
    ('java', 'class A { int a = 0, b = 00, c = 07, d = 0x8, e = 0L; double f = 09.5, g = 08e1, h = 09f; }'),
    ('c', 'int x = 07; double y = 08.5;'),
    ('c', 'static inline __attribute__((always_inline)) int f(int a) { return a; }'),
    ('cpp', 'int f() try { return 1; } catch (...) { return 0; }'),
    ('cpp', 'class A final : public B { void f() override; void g() const final { } int final = 0; };'),
]
LATER_BAD = [
    ('java', 'class A { int x = 08; }'),
    ('c', 'int x = 08;'),
    ('cpp', 'int x = 09u;'),
    ('cpp', 'void f() const const2 { }'),
    ('cpp', 'void A::f() const const2 { }'),
    ('cpp', 'struct A { void f() const const2 { } };'),
    ('go', 'package a\nvar x = 08\n'),
    ('cpp', 'struct A { void f() const const2; };'),
    ('cpp', 'int f() { return (g(a), ... b); }'),
    ('java', 'module a { exports; }'),
    ('java', 'module a { uses b }'),
]


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_grammars(lang):
    for s in GOOD[lang]:
        assert grammars.accepts(lang, s.encode("latin-1")), s
    for s in BAD[lang]:
        assert not grammars.accepts(lang, s.encode("latin-1")), s


def test_grammars_of_later_standards():
    for lang, t in LATER_GOOD:
        assert grammars.accepts(lang, t.encode()), t
    for lang, t in LATER_BAD:
        assert not grammars.accepts(lang, t.encode()), t


def test_files(spark):
    suffix = {"c": ".C", "cpp": ".hh", "java": ".java", "go": ".go", "python": ".PY", "json": ".json"}
    rows, want, i = [], set(), 0
    for lang, s in suffix.items():
        for bad, texts in ((False, GOOD[lang]), (True, BAD[lang])):
            for t in texts:
                i += 1
                rows.append((i, "t" if i % 3 else None, f"a/b{s}", t.encode("latin-1"), "clash"))
                want |= {i} if bad else set()
    rows += [(900, "t", "x.txt", b"(", ""), (901, "t", None, b"(", ""), (902, "t", "e.go", None, "")]
    df = spark.createDataFrame(rows, "file_id bigint, target_id string, path string, content binary, part string")
    for chunk in (1 << 18, 40, 3):
        assert {r["file_id"] for r in syntax.verdicts(df, chunk).filter("rejected").collect()} == want | {902}
    assert syntax.rates(df).agg(F.sum("files")).first()[0] == i + 1
    assert syntax.verdicts(df.limit(0)).count() == 0


def test_nesting_of_any_depth(spark):
    n = 20_000
    deep = {
        "a.c": f"int f(int a) {{ return {'(' * n}a{')' * n}; }}", "b.cpp": f"void f(int a) {{ {'if (a) b(); else ' * n}c(); }}", "c.java": f"class A {{ void f(int a) {{ {'if (a) b(); else ' * n}c(); }} }}",
        "d.go": f"package a\nfunc f() {{ {'if a {} else ' * n}{{}} }}\n", "e.json": "[" * n + '{"a": ' * n + "1" + "}" * n + "]" * n,
    }
    bad = {"f.c": deep["a.c"].replace("); }", "; }"), "g.java": deep["c.java"].replace("c()", "c("), "h.json": deep["e.json"].replace("1", "NaN"), "i.json": deep["e.json"][:-1]}
    df = spark.createDataFrame([(i, "t", p, t.encode()) for i, (p, t) in enumerate({**deep, **bad}.items())], "file_id bigint, target_id string, path string, content binary")
    for chunk in (1 << 18, 1000):
        assert {r["file_id"] for r in syntax.verdicts(df, chunk).filter("rejected").collect()} == {5, 6, 7, 8}


def test_macros_expand_to_any_level():
    family = ["#define E_1(f, x) f(x)", *[f"#define E_{i}(f, x, ...) f(x) E_{i - 1}(f, __VA_ARGS__)" for i in range(2, 65)]]
    call = f"E_64(D, {', '.join(f'a{i}' for i in range(64))})"
    text = "\n".join([*family, "#define D(x) int x;", call, ""])
    left = grammars.preprocessed("c", lexers.lex("c", text)[0])
    assert [t for _, t in left if t != ";"] == [x for i in range(64) for x in ("int", f"a{i}")]
    assert grammars.accepts("c", text.encode())
    chain = "\n".join(["#define M0 int x;", *[f"#define M{i} M{i - 1}" for i in range(1, 3000)], "M2999", ""])
    assert [t for _, t in grammars.preprocessed("c", lexers.lex("c", chain)[0])] == ["int", "x", ";"]
    loop = "#define A B A\n#define B A B\nint A;\n"
    assert [t for _, t in grammars.preprocessed("c", lexers.lex("c", loop)[0])] == ["int", "A", "B", "A", ";"]


def test_chunk_maps_are_associative():
    text = 'a ] { /* x\n } */ ( "}" \n """\n ) } \n""" ) { [\n'
    lines = text.splitlines(keepends=True)
    a, b, c = (lexers.chunk_map("java", x) for x in ("".join(lines[:1]), "".join(lines[1:3]), "".join(lines[3:])))
    assert lexers.compose(lexers.compose(a, b), c) == lexers.compose(a, lexers.compose(b, c))
    assert lexers.compose(lexers.compose(a, b), c)["code"] == lexers.chunk_map("java", text)["code"]


def test_tokens(spark):
    rng = random.Random(1)
    texts = ["", None, " ", "\n\n  a", "<|endoftext|> it's 'the' end", "x" * 5000, "漢字" * 900, "a\u00a0b\u2028c \U0001f511\u200d", "''s" * 400, "".join(rng.choice(string.printable + "é漢 ") for _ in range(4000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(99, "a b", 2)], "doc_id bigint, text string, part int")
    whole = tokens.encoder("byte_bpe_50k")
    for chunk, overlap in ((32768, 2048), (500, 60), (50, 10)):
        got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: whole([t or ""])[0] for i, t in enumerate(texts)} | {99: whole(["a b"])[0]}
    assert tokens.decode(got[9]).decode() == texts[9]
    assert tokens.encoded(df.limit(0)).count() == 0
    assert tokens.encoded(df, name="piece_bpe_32k").count() == 11 == tokens.encoded(df, name="word_bpe_49k").count()


def test_bucket_bounds_against_all():
    from itertools import combinations

    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 9)))
        counts = rng.integers(1, 20, len(lengths))
        k = int(rng.integers(1, 5))
        pad = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(lengths, counts))
        best = min(pad([*some, lengths[-1]]) for n in range(k) for some in combinations(lengths[:-1], n))
        got = packing.bucket_bounds(lengths, counts, k)
        assert len(got) <= k and got[-1] == lengths[-1] and pad(got) == best


def test_containers(spark):
    rng = random.Random(2)
    texts = [None, "", "a b c", *["w " * rng.randint(1, 60) for _ in range(200)], "w " * 500] + ["same text"] * 50
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, length string")
    caps = spark.createDataFrame([("small", "byte_bpe_50k", 64), ("big", "byte_bpe_50k", 300)], "container_kind string, tokenizer string, capacity int")
    sizes = [len(x) for x in tokens.encoder("byte_bpe_50k")([t or "" for t in texts])]
    got = packing.containers(docs, caps).toPandas()
    for kind, cap in (("small", 64), ("big", 300)):
        g = got[got.container_kind == kind]
        used = (g.end_token - g.start_token).groupby(g.container_id).sum()
        assert used.max() <= cap and sorted(used.index) == list(range(len(used))) and len(used) <= -(-sum(sizes) // cap) * 1.05 + 1
        for d, own in g.groupby("doc_id"):
            own = own.sort_values("part_no")
            assert own.end_token.iloc[-1] == sizes[d] and own.start_token.iloc[0] == 0 and (len(own) == 1) == (sizes[d] <= cap) and list(own.start_token[1:]) == list(own.end_token[:-1])
    assert packing.containers(docs.limit(0), caps).count() == 0
    b = packing.batches(docs, caps, buckets=4).toPandas()
    assert b[b.container_kind == "big"]["items"].sum() == sum(-(-s // 300) for s in sizes)


def test_batches_hold_every_item_once(spark):
    rng = random.Random(3)
    texts = [None, "", *["w " * rng.randint(1, 60) for _ in range(200)], "w " * 500] + ["same text"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    caps = spark.createDataFrame([("small", "byte_bpe_50k", 64), ("big", "byte_bpe_50k", 300)], "container_kind string, tokenizer string, capacity int")
    sizes = [len(x) for x in tokens.encoder("byte_bpe_50k")([t or "" for t in texts])]
    got = packing.batched(docs, caps, buckets=4).toPandas()
    got["length"] = got.end_token - got.start_token
    sums = packing.batches(docs, caps, buckets=4).toPandas().set_index(["container_kind", "bucket_no"])
    for kind, cap in (("small", 64), ("big", 300)):
        g = got[got.container_kind == kind]
        want = sorted((d, p, p * cap, min(n, (p + 1) * cap)) for d, n in enumerate(sizes) for p in range(-(-n // cap)))
        assert sorted(zip(g.doc_id, g.part_no, g.start_token, g.end_token)) == want
        bounds = packing.bucket_bounds(*np.unique(g.length, return_counts=True), 4)
        assert [bounds[i] for i in g.bucket_no] == list(g.bound) and all(np.searchsorted(bounds, g.length) == g.bucket_no)
        for (i, bound), own in g.groupby(["bucket_no", "bound"]):
            n = own.batch_no.value_counts().sort_index()
            fit = cap // bound
            assert list(n.index) == list(range(len(n))) and all(n[:-1] == fit) and 0 < n.iloc[-1] <= fit
            s = sums.loc[(kind, i)]
            assert (s["items"], s.batches, s.tokens, s.padding) == (len(own), len(n), own.length.sum(), (bound - own.length).sum())


TEXTS = {
    'He left at 9 p.m. She stayed, e.g. with Dr. Moe. Why? "We will." That was it.': ["He left at 9 p.m.", "She stayed, e.g. with Dr. Moe.", "Why?", '"We will."', "That was it."],
    "Both name libssl.so.2. openssl 3.2 does not. Wait... what? (See Tab. 3.) Done: 1.) AES 2.) DES. Ok": ["Both name libssl.so.2.", "openssl 3.2 does not.", "Wait... what?", "(See Tab. 3.)", "Done: 1.) AES 2.) DES.", "Ok"],
    "Am 2. Mai, z. B. hier, d. h. bald. Der 3. Lauf am 8. d. M. war gut.": ["Am 2. Mai, z. B. hier, d. h. bald.", "Der 3. Lauf am 8. d. M. war gut."],
    "「鍵を替えて。すぐに！」と彼女は書いた。はい。": ["「鍵を替えて。すぐに！」と彼女は書いた。", "はい。"],
    "审计员说：“这不在清单上。”“为什么？”她问道。好……的。": ["审计员说：“这不在清单上。”", "“为什么？”她问道。", "好……的。"],
    "# Head. Line\n- One. Two\n- Three\n\nText that is\nwrapped here. End": ["# Head. Line", "- One.", "Two", "- Three", "Text that is\nwrapped here.", "End"],
    "error: it failed. Now at x.c:3\r\n\r\nमिला। हाँ।": ["error: it failed. Now at x.c:3", "मिला।", "हाँ।"],
    "« C'est dit », a-t-il écrit. Est-ce sûr ? Non.": ["« C'est dit », a-t-il écrit.", "Est-ce sûr ?", "Non."],
}


def test_long_lists():
    cut = lambda t: [t[a:b] for a, b in sentences.segment(t)]
    lines = [f"{i}. item of the list" for i in range(1, 1205)]
    assert cut("\n".join(lines)) == lines
    letters = ["A) one", "B) two", "(C) three"]
    assert cut("\n".join(letters)) == letters
    assert cut("It was made in\n2004. Nobody knew of it then.")[0] == "It was made in\n2004."
    assert cut("a) one\nB) two") == ["a) one\nB) two"]  # a list goes on in its own case


def test_sentences(spark):
    for t, want in TEXTS.items():
        assert [t[a:b] for a, b in sentences.segment(t)] == want
    texts = [*TEXTS, None, "", " \n\t ", "no end", "\n\n".join(TEXTS) * 3, "a.\r\n\r\nb.\r\r" * 40]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, start_pos int")
    want = {(i, a, b) for i, t in enumerate(texts) if t for a, b in sentences.segment(t)}
    for chunk in (sentences.CHUNK, 100, 9):
        assert {tuple(r) for r in sentences.sentences(df, chunk=chunk).collect()} == want
    assert sentences.sentences(df.limit(0)).count() == 0


PIECES = ["Mr. ", "e.g. ", "word ", "Word ", ". ", "? ", "。", "「", "」", "(", ")", '"', "“", "”", "«", "»", "\n", "\n\n", " \n", "\r\n\r\n", "- item ", "1. ", "2. ", "a) ", "b) ", "# Head ", "error: x", "so: \n", "P. M. ", "x=1;\n", "กข ", "漢字", "„", "…", "\u2028"]


def test_transducer_of_chunks_against_the_whole_text():
    rng = random.Random(7)
    for _ in range(1500):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60)))
        want = sentences.segment(t)
        for size in (3, 10, 40):
            chunks = [sentences._chunk(*sentences.view(t, x)) for x in sentences.cut(t, size)]
            tables = [json.loads(json.dumps(sentences.table(c))) for c in chunks]
            states = [sentences.START]
            for f in tables:
                states.append(sentences.apply(f, states[-1]))
            assert [x for c, s in zip(chunks, states) for x in sentences.read(c, s)] == want
            if len(tables) > 2:
                a, b, c = tables[:3]
                left, right = sentences.compose(sentences.compose(a, b), c), sentences.compose(a, sentences.compose(b, c))
                assert sentences.apply(left, sentences.START) == sentences.apply(right, sentences.START) == states[3]


def test_scan_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sentences, "FAN", 3)
    text = "It is so. (Is it? Yes.) " * 40 + "\n- one. two\n- three " * 9
    df = spark.createDataFrame([(1, text), (2, "Short. Text.")], "doc_id bigint, text string")
    got = {tuple(r) for r in sentences.sentences(df, chunk=50).collect()}
    assert got == {(i, a, b) for i, t in ((1, text), (2, "Short. Text.")) for a, b in sentences.segment(t)}


def test_sentences_take_time_in_proportion():
    for t in ("«" * 48_000, "(" * 24_000, "(a " * 20_000, '"' * 50_000, "A. " * 20_000, "漢字。" * 20_000):
        began = time.time()
        sentences.segment(t)
        assert time.time() - began < 5


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found"])
def test_queries_with_split_sizes_in_megabytes(spark, name):
    d = Path("/root/testdata/sf0.01")
    if not d.exists():
        pytest.skip("no test tables")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    want = sorted(map(str, registry.QUERIES[name](spark, str(d)).collect()))
    try:
        spark.conf.set(key, "16m")
        got = sorted(map(str, registry.QUERIES[name](spark, str(d)).collect()))
    finally:
        spark.conf.set(key, before)
    assert got == want != []
