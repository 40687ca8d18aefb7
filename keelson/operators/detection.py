"""Sightings found in text: calls, includes, cipher suites, transformations, packages, endpoints. Expressions over whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The call rules: id | call with its receiver | algorithm | parameters | functions | library | argument that says more, and its place.
RULES = {
    "c": """
openssl.evp.aes_128_cbc | EVP_aes_128_cbc | AES | key_size=128 mode=cbc | encrypt decrypt | openssl |
openssl.evp.aes_192_cbc | EVP_aes_192_cbc | AES | key_size=192 mode=cbc | encrypt decrypt | openssl |
openssl.evp.aes_256_cbc | EVP_aes_256_cbc | AES | key_size=256 mode=cbc | encrypt decrypt | openssl |
openssl.evp.aes_128_gcm | EVP_aes_128_gcm | AES | key_size=128 mode=gcm | encrypt decrypt | openssl |
openssl.evp.aes_256_gcm | EVP_aes_256_gcm | AES | key_size=256 mode=gcm | encrypt decrypt | openssl |
openssl.evp.aes_256_ctr | EVP_aes_256_ctr | AES | key_size=256 mode=ctr | encrypt decrypt | openssl |
openssl.evp.des_ede3_cbc | EVP_des_ede3_cbc | 3DES | mode=cbc | encrypt decrypt | openssl |
openssl.evp.des_cbc | EVP_des_cbc | DES | mode=cbc | encrypt decrypt | openssl |
openssl.evp.rc4 | EVP_rc4 | RC4 |  | encrypt decrypt | openssl |
openssl.evp.chacha20 | EVP_chacha20_poly1305 | ChaCha20 |  | encrypt decrypt | openssl |
openssl.evp.md5 | EVP_md5 | MD5 |  | digest | openssl |
openssl.evp.sha1 | EVP_sha1 | SHA-1 |  | digest | openssl |
openssl.evp.sha256 | EVP_sha256 | SHA-2 | key_size=256 | digest | openssl |
openssl.evp.sha384 | EVP_sha384 | SHA-2 | key_size=384 | digest | openssl |
openssl.evp.sha512 | EVP_sha512 | SHA-2 | key_size=512 | digest | openssl |
openssl.rsa.generate_key_ex | RSA_generate_key_ex | RSA |  | keygen | openssl | key_size 1
openssl.rsa.generate_key | RSA_generate_key | RSA |  | keygen | openssl | key_size 0
openssl.evp.rsa_keygen_bits | EVP_PKEY_CTX_set_rsa_keygen_bits | RSA |  | keygen | openssl | key_size 1
openssl.ec.new_by_curve_name | EC_KEY_new_by_curve_name | ECDSA |  | keygen | openssl | curve_nid 0
openssl.ecdsa.sign | ECDSA_do_sign | ECDSA |  | sign | openssl |
openssl.ecdh.compute_key | ECDH_compute_key | ECDH |  | keyderive | openssl |
openssl.dh.generate_key | DH_generate_key | DH |  | keygen | openssl |
openssl.sha256.init | SHA256_Init | SHA-2 | key_size=256 | digest | openssl |
openssl.sha1.init | SHA1_Init | SHA-1 |  | digest | openssl |
openssl.md5.init | MD5_Init | MD5 |  | digest | openssl |
openssl.aes.set_encrypt_key | AES_set_encrypt_key | AES |  | encrypt | openssl | key_size 1
openssl.des.set_key | DES_set_key | DES |  | encrypt | openssl |
openssl.pbkdf2 | PKCS5_PBKDF2_HMAC | PBKDF2 |  | keyderive | openssl |
openssl.hmac | HMAC | HMAC |  | tag | openssl |
mbedtls.aes.setkey_enc | mbedtls_aes_setkey_enc | AES |  | encrypt | mbedtls | key_size 2
mbedtls.aes.setkey_dec | mbedtls_aes_setkey_dec | AES |  | decrypt | mbedtls | key_size 2
mbedtls.rsa.gen_key | mbedtls_rsa_gen_key | RSA |  | keygen | mbedtls | key_size 3
mbedtls.sha256.starts | mbedtls_sha256_starts | SHA-2 | key_size=256 | digest | mbedtls |
mbedtls.sha1.starts | mbedtls_sha1_starts | SHA-1 |  | digest | mbedtls |
mbedtls.md5.starts | mbedtls_md5_starts | MD5 |  | digest | mbedtls |
mbedtls.ecdsa.genkey | mbedtls_ecdsa_genkey | ECDSA |  | keygen | mbedtls |
sodium.sign.detached | crypto_sign_detached | EdDSA | curve=Ed25519 | sign | libsodium |
sodium.sign.keypair | crypto_sign_keypair | EdDSA | curve=Ed25519 | keygen | libsodium |
sodium.box.easy | crypto_box_easy | X25519 |  | encrypt | libsodium |
sodium.scalarmult | crypto_scalarmult | X25519 |  | keyderive | libsodium |
sodium.aead.aes256gcm | crypto_aead_aes256gcm_encrypt | AES | key_size=256 mode=gcm | encrypt | libsodium |
""",
    "java": """
jca.cipher.getinstance | Cipher.getInstance |  |  | encrypt decrypt | jca | jca_spec 0
jca.messagedigest.getinstance | MessageDigest.getInstance |  |  | digest | jca | algorithm 0
jca.signature.getinstance | Signature.getInstance |  |  | sign verify | jca | algorithm 0
jca.keypairgenerator.getinstance | KeyPairGenerator.getInstance |  |  | keygen | jca | algorithm 0
jca.keygenerator.getinstance | KeyGenerator.getInstance |  |  | keygen | jca | algorithm 0
jca.mac.getinstance | Mac.getInstance |  |  | tag | jca | algorithm 0
jca.secretkeyfactory.getinstance | SecretKeyFactory.getInstance |  |  | keyderive | jca | algorithm 0
jca.keyagreement.getinstance | KeyAgreement.getInstance |  |  | keyderive | jca | algorithm 0
jca.keystore.getinstance | KeyStore.getInstance |  |  | other | jca | algorithm 0 skip
""",
    "go": """
go.aes.newcipher | aes.NewCipher | AES |  | encrypt decrypt | crypto/aes |
go.des.newcipher | des.NewCipher | DES |  | encrypt decrypt | crypto/des |
go.des.newtripledescipher | des.NewTripleDESCipher | 3DES |  | encrypt decrypt | crypto/des |
go.rc4.newcipher | rc4.NewCipher | RC4 |  | encrypt decrypt | crypto/rc4 |
go.rsa.generatekey | rsa.GenerateKey | RSA |  | keygen | crypto/rsa | key_size 1
go.ecdsa.generatekey | ecdsa.GenerateKey | ECDSA |  | keygen | crypto/ecdsa |
go.ed25519.generatekey | ed25519.GenerateKey | EdDSA | curve=Ed25519 | keygen | crypto/ed25519 |
go.elliptic.p256 | elliptic.P256 | ECDSA | curve=P-256 | keygen | crypto/elliptic |
go.elliptic.p384 | elliptic.P384 | ECDSA | curve=P-384 | keygen | crypto/elliptic |
go.elliptic.p521 | elliptic.P521 | ECDSA | curve=P-521 | keygen | crypto/elliptic |
go.md5.new | md5.New | MD5 |  | digest | crypto/md5 |
go.sha1.new | sha1.New | SHA-1 |  | digest | crypto/sha1 |
go.sha256.new | sha256.New | SHA-2 | key_size=256 | digest | crypto/sha256 |
go.sha512.new | sha512.New | SHA-2 | key_size=512 | digest | crypto/sha512 |
go.hmac.new | hmac.New | HMAC |  | tag | crypto/hmac |
go.sha256.sum256 | sha256.Sum256 | SHA-2 | key_size=256 | digest | crypto/sha256 |
go.sha256.sum224 | sha256.Sum224 | SHA-2 | key_size=224 | digest | crypto/sha256 |
go.sha512.sum512 | sha512.Sum512 | SHA-2 | key_size=512 | digest | crypto/sha512 |
go.sha1.sum | sha1.Sum | SHA-1 |  | digest | crypto/sha1 |
go.md5.sum | md5.Sum | MD5 |  | digest | crypto/md5 |
go.ed25519.sign | ed25519.Sign | EdDSA | curve=Ed25519 | sign | crypto/ed25519 |
go.rsa.signpkcs1v15 | rsa.SignPKCS1v15 | RSA | padding=pkcs1v15 | sign | crypto/rsa |
go.rsa.encryptoaep | rsa.EncryptOAEP | RSA | padding=oaep | encrypt | crypto/rsa |
go.ecdsa.sign | ecdsa.SignASN1 | ECDSA |  | sign | crypto/ecdsa |
""",
}
# Curves by their numeric identifiers' names.
CURVE_NIDS = {"NID_X9_62_prime256v1": "P-256", "NID_secp256r1": "P-256", "NID_secp384r1": "P-384", "NID_secp521r1": "P-521", "NID_secp224r1": "P-224", "NID_secp256k1": "secp256k1", "NID_X25519": "X25519", "NID_X448": "X448"}


def rule_rows() -> list[tuple]:
    """lang, ord, id, call_name, receiver, algorithm, parameters, functions, library, arg_kind, arg_index, skip_unresolved of the call rules."""
    out = []
    for lang, text in RULES.items():
        for n, line in enumerate(text.strip().splitlines()):
            rule, call, algorithm, parameters, functions, library, arg = (x.strip() or None for x in (line + " ").split("|"))
            receiver, _, name = call.rpartition(".")
            kind, place, *skip = (arg or "").split() or (None, None)
            out.append((lang, n, rule, name, receiver or None, algorithm, dict(p.split("=") for p in (parameters or "").split()), (functions or "").split(), library, kind, None if place is None else int(place), bool(skip)))
    return out


def _known_calls() -> dict[str, dict[str, tuple]]:
    out: dict[str, dict[str, tuple]] = {lang: {} for lang in RULES}
    for lang, _, _, name, receiver, algorithm, parameters, _, _, kind, place, _ in rule_rows():
        size = parameters.get("key_size") or (f"@{place}" if kind == "key_size" else None)
        out[lang][f"{receiver}.{name}" if receiver else name] = (algorithm or f"@{place}", size, parameters.get("mode"))
    return out


#: call (receiver.call in Java and Go): algorithm, key size, mode; @n is what argument n says.
CALLS = _known_calls()
# What an include or import says about libraries, in order.
INCLUDES = {
    "openssl/evp.h": "openssl", "openssl/rsa.h": "openssl", "openssl/ec.h": "openssl", "openssl/aes.h": "openssl", "openssl/sha.h": "openssl", "openssl/ssl.h": "openssl", "sodium.h": "libsodium", "mbedtls/aes.h": "mbedtls",
    "mbedtls/rsa.h": "mbedtls", "cryptopp/aes.h": "cryptopp", "javax.crypto": "jca", "java.security": "jca", "org.bouncycastle": "bouncycastle", "crypto/tls": "crypto/tls", "crypto/sha256": "crypto/sha256", "crypto/rsa": "crypto/rsa",
    "crypto/aes": "crypto/aes", "crypto/ecdsa": "crypto/ecdsa", "crypto/md5": "crypto/md5", "crypto/ed25519": "crypto/ed25519",
}
# Parts of cipher suites in the order they are taken out.
SUITE_TOKENS = {
    "ECDHE": "ECDH", "ECDH": "ECDH", "DHE": "DH", "AES_256_GCM": "AES-256-GCM", "AES_128_GCM": "AES-128-GCM", "AES256-GCM": "AES-256-GCM", "AES128-GCM": "AES-128-GCM", "AES_256_CBC": "AES-256-CBC", "AES_128_CBC": "AES-128-CBC",
    "AES256-SHA": "AES-256-CBC", "AES128-SHA": "AES-128-CBC", "CHACHA20": "ChaCha20", "3DES": "3DES", "DES-CBC3": "3DES", "RC4": "RC4", "SHA384": "SHA-384", "SHA256": "SHA-256", "_SHA": "SHA-1",
}
# Paddings of transformations, and prefixes of packages of interest.
PADDINGS = {"nopadding": "raw", "pkcs5padding": "pkcs5", "pkcs7padding": "pkcs7", "pkcs1padding": "pkcs1v15", "oaeppadding": "oaep"}
PACKAGES = ("openssl", "libssl", "libcrypto", "libgcrypt", "gnutls", "libgnutls", "nss", "libnss", "libsodium", "mbedtls", "wolfssl", "ca-certificates")
SUFFIXES = {".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".cxx": "c", ".hpp": "c", ".hh": "c", ".hxx": "c", ".java": "java", ".go": "go"}
#: Bytes of a source file that is read, and of other files.
SOURCE_CAP = 4 << 20

NOISE = r'/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
CALL = r"((?:[A-Za-z_][A-Za-z0-9_]*\.)?[A-Za-z_][A-Za-z0-9_]*)\("


def suffix_language(path: Column) -> Column:
    s = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for suffix, lang in SUFFIXES.items():
        out = F.when(s == suffix, lang).otherwise(out)
    return out


def calls(files: DataFrame) -> DataFrame:
    """file_id, target_id, path, call, algorithm, key_size, mode, hits: calls of the rules in files of a known suffix up to SOURCE_CAP bytes.

    Comments and strings are taken out first. The rules are a literal table of dozens of entries. Files that are too long, null or of
    another suffix have no rows.
    """
    from keelson.functions.dims import lookup

    src = files.select("file_id", "target_id", "path", suffix_language(F.col("path")).alias("lang"), "content").filter("lang IS NOT NULL AND length(content) <= %d" % SOURCE_CAP)
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), NOISE, " ")
    found = src.select("file_id", "target_id", "path", "lang", F.explode(F.regexp_extract_all(text, F.lit(CALL), 1)).alias("call"))
    table = {f"{lang}|{c}": "|".join(x or "" for x in rule) for lang, rules in CALLS.items() for c, rule in rules.items()}
    hit = found.withColumn("rule", lookup(table, F.concat_ws("|", "lang", "call"))).filter("rule IS NOT NULL")
    hit = hit.groupBy("file_id", "target_id", "path", "call", "rule").agg(F.count(F.lit(1)).alias("hits"))
    part = F.split("rule", r"\|")
    return hit.select("file_id", "target_id", "path", "call", *[F.nullif(F.get(part, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("algorithm", "key_size", "mode"))], "hits")


def includes(files: DataFrame) -> DataFrame:
    """file_id, target_id, path, library: the libraries that a file's include and import lines name, once for each file."""
    src = files.select("file_id", "target_id", "path", suffix_language(F.col("path")).alias("lang"), "content").filter("lang IS NOT NULL AND length(content) <= %d" % SOURCE_CAP)
    lines = src.select("file_id", "target_id", "path", F.explode(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r'(?m)^[ \t]*(?:#[ \t]*include|import)?[ \t]*(?:static )?([<"][^\n]*[>"]|[a-z][A-Za-z0-9_.]*\*?;)[ \t\r]*$'), 1)).alias("line"))
    lib = F.lit(None).cast("string")
    for needle, library in reversed(INCLUDES.items()):
        lib = F.when(F.contains("line", F.lit(needle)), library).otherwise(lib)
    return lines.select("file_id", "target_id", "path", lib.alias("library")).filter("library IS NOT NULL").distinct()


def suite_parts(suite: Column) -> Column:
    """The algorithms of a cipher suite: each token is looked for in what the tokens before it left, and taken out once."""
    tokens = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).alias("a")) for t, a in SUITE_TOKENS.items()])

    def take(acc: Column, x: Column) -> Column:
        at = F.position(x["t"], acc["rest"])
        rest = F.concat(F.substr(acc["rest"], F.lit(1), at - 1), F.substr(acc["rest"], at + F.length(x["t"])))
        return F.when(at > 0, F.struct(rest.alias("rest"), F.concat(acc["hits"], F.array(x["a"])).alias("hits"))).otherwise(acc)

    start = F.struct(F.upper(suite).alias("rest"), F.array().cast("array<string>").alias("hits"))
    return F.when(suite.isNotNull(), F.aggregate(tokens, start, take, lambda acc: acc["hits"]))


def transformation(spec: Column) -> Column:
    """algorithm, mode and padding of a transformation such as AES/GCM/NoPadding."""
    from keelson.functions.dims import lookup

    parts = F.transform(F.split(spec, "/"), lambda x: F.trim(x))
    padding = F.lower(F.nullif(F.get(parts, F.lit(2)), F.lit("")))
    return F.struct(F.get(parts, F.lit(0)).alias("algorithm"), F.lower(F.nullif(F.get(parts, F.lit(1)), F.lit(""))).alias("mode"), F.when(padding.isNotNull(), F.coalesce(lookup(PADDINGS, padding), F.when(padding.startswith("oaep"), "oaep").otherwise("other"))).alias("padding"))


def packages(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, package, version of the stanzas of a package database in text, of packages of interest, each once."""
    stanzas = df.select(*keys, F.explode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+")).alias("s"))
    field = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_extract("s", rf"(?m)^{n}:[ \t]*(.*)$", 1)), F.lit("")) for n in names])
    got = stanzas.select(*keys, field("Package", "P").alias("package"), field("Version", "V").alias("version"))
    return got.filter(F.col("package").rlike("^(?:" + "|".join(PACKAGES) + ")")).distinct()


def target_kind(raw: Column) -> Column:
    """What a target that doesn't exist as a path is by its spelling: container, endpoint or unknown."""
    port = F.coalesce(F.regexp_extract(raw, r"^(?:\[[0-9a-fA-F:]+\]|[A-Za-z0-9._-]+):(\d{1,5})$", 1).try_cast("int"), F.lit(0))
    return F.when(F.lower(raw).rlike(r"\.(tar|tar\.gz|tgz|oci)$"), "container").when(port.between(1, 65535), "endpoint").otherwise("unknown")
