"""The registry of algorithms and the policy, as plain tables of fixed values, and their forms in Spark and in SQL.

All are literals in plans: dozens of entries, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family: primitive, quantum status, attack, classical status, parameter, default, standard, security bits, quantum bits, levels, identifiers.
FAMILIES: dict[str, dict] = {
    "RSA": {"primitive": "pke", "quantum": "broken", "attack": "shor", "classical": "ok", "parameter": "key_size", "bits": {"1024": 80, "2048": 112, "3072": 128, "4096": 152, "7680": 192}, "oids": {"*": "1.2.840.113549.1.1.1"}},
    "DSA": {"primitive": "signature", "quantum": "broken", "attack": "shor", "classical": "deprecated", "parameter": "key_size", "bits": {"1024": 80, "2048": 112, "3072": 128}, "oids": {"*": "1.2.840.10040.4.1"}},
    "DH": {"primitive": "key-agree", "quantum": "broken", "attack": "shor", "classical": "ok", "parameter": "key_size", "bits": {"1024": 80, "2048": 112, "3072": 128, "4096": 152}, "oids": {"*": "1.2.840.113549.1.3.1"}},
    "ECDSA": {"primitive": "signature", "quantum": "broken", "attack": "shor", "classical": "ok", "parameter": "curve", "bits": {"P-192": 96, "P-224": 112, "P-256": 128, "P-384": 192, "P-521": 256, "secp256k1": 128, "brainpoolP256r1": 128, "brainpoolP384r1": 192}, "oids": {"*": "1.2.840.10045.2.1"}},
    "ECDH": {"primitive": "key-agree", "quantum": "broken", "attack": "shor", "classical": "ok", "parameter": "curve", "bits": {"P-192": 96, "P-224": 112, "P-256": 128, "P-384": 192, "P-521": 256, "secp256k1": 128, "X25519": 128, "X448": 224}, "oids": {"*": "1.3.132.1.12"}},
    "EdDSA": {"primitive": "signature", "quantum": "broken", "attack": "shor", "classical": "ok", "parameter": "curve", "bits": {"Ed25519": 128, "Ed448": 224}, "oids": {"Ed25519": "1.3.101.112", "Ed448": "1.3.101.113"}},
    "X25519": {"primitive": "key-agree", "quantum": "broken", "attack": "shor", "classical": "ok", "bits": {"*": 128}, "oids": {"*": "1.3.101.110"}},
    "AES": {"primitive": "block-cipher", "quantum": "weakened", "attack": "grover", "classical": "ok", "parameter": "key_size", "bits": {"128": 128, "192": 192, "256": 256}, "quantum_bits": {"128": 64, "192": 96, "256": 128}, "oids": {"128": "2.16.840.1.101.3.4.1.2", "192": "2.16.840.1.101.3.4.1.22", "256": "2.16.840.1.101.3.4.1.42"}},
    "ChaCha20": {"primitive": "stream-cipher", "quantum": "weakened", "attack": "grover", "classical": "ok", "bits": {"*": 256}, "quantum_bits": {"*": 128}},
    "3DES": {"primitive": "block-cipher", "quantum": "broken", "attack": "grover", "classical": "disallowed", "bits": {"*": 112}, "quantum_bits": {"*": 56}, "oids": {"*": "1.2.840.113549.3.7"}},
    "DES": {"primitive": "block-cipher", "quantum": "broken", "attack": "grover", "classical": "broken", "bits": {"*": 56}, "oids": {"*": "1.3.14.3.2.7"}},
    "RC4": {"primitive": "stream-cipher", "quantum": "broken", "attack": "grover", "classical": "broken", "bits": {"*": 40}},
    "Blowfish": {"primitive": "block-cipher", "quantum": "weakened", "attack": "grover", "classical": "deprecated", "bits": {"*": 128}},
    "MD5": {"primitive": "hash", "quantum": "broken", "attack": "grover", "classical": "broken", "bits": {"*": 0}, "oids": {"*": "1.2.840.113549.2.5"}},
    "SHA-1": {"primitive": "hash", "quantum": "broken", "attack": "grover", "classical": "broken", "bits": {"*": 0}, "oids": {"*": "1.3.14.3.2.26"}},
    "SHA-2": {"primitive": "hash", "quantum": "safe", "classical": "ok", "parameter": "key_size", "bits": {"224": 112, "256": 128, "384": 192, "512": 256}, "quantum_bits": {"224": 112, "256": 128, "384": 192, "512": 256}, "oids": {"256": "2.16.840.1.101.3.4.2.1", "384": "2.16.840.1.101.3.4.2.2", "512": "2.16.840.1.101.3.4.2.3"}},
    "SHA-3": {"primitive": "hash", "quantum": "safe", "classical": "ok", "parameter": "key_size", "bits": {"224": 112, "256": 128, "384": 192, "512": 256}},
    "HMAC": {"primitive": "mac", "quantum": "safe", "classical": "ok", "bits": {"*": 128}},
    "PBKDF2": {"primitive": "kdf", "quantum": "safe", "classical": "ok", "bits": {"*": 128}},
    "HKDF": {"primitive": "kdf", "quantum": "safe", "classical": "ok", "bits": {"*": 128}},
    "ML-KEM": {"primitive": "kem", "quantum": "safe", "classical": "ok", "standard": "FIPS 203", "parameter": "key_size", "default": "768", "bits": {"512": 128, "768": 192, "1024": 256}, "levels": {"512": 1, "768": 3, "1024": 5}},
    "ML-DSA": {"primitive": "signature", "quantum": "safe", "classical": "ok", "standard": "FIPS 204", "parameter": "key_size", "default": "65", "bits": {"44": 128, "65": 192, "87": 256}, "levels": {"44": 2, "65": 3, "87": 5}},
    "SLH-DSA": {"primitive": "signature", "quantum": "safe", "classical": "ok", "standard": "FIPS 205", "parameter": "key_size", "default": "128", "bits": {"128": 128, "192": 192, "256": 256}, "levels": {"128": 1, "192": 3, "256": 5}},
    "TLS": {"primitive": "other", "quantum": "depends", "classical": "ok", "parameter": "version", "bits": {"*": 0}},
}
# Other spellings of families.
ALIASES = {
    "rsaencryption": "RSA", "rsassa-pss": "RSA", "rsassapss": "RSA", "rsa_pkcs1": "RSA", "sha1withrsa": "RSA", "sha256withrsa": "RSA", "sha384withrsa": "RSA", "sha512withrsa": "RSA", "md5withrsa": "RSA",
    "ecdsa-with-sha256": "ECDSA", "ecdsa-with-sha384": "ECDSA", "ecdsa-with-sha512": "ECDSA", "sha256withecdsa": "ECDSA", "prime256v1": "ECDSA", "ed25519": "EdDSA", "ed448": "EdDSA", "curve25519": "X25519", "x25519": "X25519",
    "aes": "AES", "aes128": "AES", "aes192": "AES", "aes256": "AES", "des-ede3": "3DES", "des-ede3-cbc": "3DES", "tripledes": "3DES", "desede": "3DES", "triple-des": "3DES", "arcfour": "RC4", "rc4": "RC4", "md5": "MD5",
    "sha1": "SHA-1", "sha": "SHA-1", "sha224": "SHA-2", "sha256": "SHA-2", "sha384": "SHA-2", "sha512": "SHA-2", "sha2": "SHA-2", "sha3": "SHA-3", "sha3-256": "SHA-3", "sha3-512": "SHA-3", "kyber": "ML-KEM", "mlkem": "ML-KEM",
    "dilithium": "ML-DSA", "mldsa": "ML-DSA", "sphincs+": "SLH-DSA", "sphincs": "SLH-DSA", "slhdsa": "SLH-DSA", "chacha20": "ChaCha20", "chacha20-poly1305": "ChaCha20", "poly1305": "HMAC", "hmac": "HMAC", "pbkdf2": "PBKDF2",
    "hkdf": "HKDF", "blowfish": "Blowfish", "bf": "Blowfish", "sha256withrsaencryption": "RSA", "sha384withrsaencryption": "RSA", "sha512withrsaencryption": "RSA", "sha1withrsaencryption": "RSA", "md5withrsaencryption": "RSA",
    "rsaessaoaep": "RSA", "ecdsa-with-sha1": "ECDSA", "dsa-with-sha256": "DSA", "id-ecpublickey": "ECDSA", "evp-aes": "AES", "aes-gcm": "AES",
}
# Other spellings of curves.
CURVES = {
    "prime256v1": "P-256", "secp256r1": "P-256", "nistp256": "P-256", "p256": "P-256", "secp384r1": "P-384", "prime384v1": "P-384", "nistp384": "P-384", "p384": "P-384", "secp521r1": "P-521", "nistp521": "P-521",
    "p521": "P-521", "secp224r1": "P-224", "secp192r1": "P-192", "x25519": "X25519", "x448": "X448", "ed25519": "Ed25519", "ed448": "Ed448",
}
# Names that families are shown with; {p} is the parameter.
TEMPLATES = {"SHA-2": "SHA-{p}", "SHA-3": "SHA3-{p}", "TLS": "TLS{p}", "X25519": "X25519", "HMAC": "HMAC", "PBKDF2": "PBKDF2", "HKDF": "HKDF", "RC4": "RC4", "DES": "DES", "3DES": "3DES", "MD5": "MD5", "SHA-1": "SHA-1", "ChaCha20": "ChaCha20", "Blowfish": "Blowfish"}
MODE_BEARING = ("block-cipher", "stream-cipher", "ae")
# Fixed value: the prefix that the data's property names have.
PREFIX = "qdarpan:"
# Parameters that enter an asset's identity.
SIGNIFICANT = ("curve", "hash", "key_size", "mode", "padding", "version")
# Evidence tiers from the strongest, with the confidence each gives.
TIERS = {"negotiated": 0.99, "direct_api_call": 0.95, "linked_library_pinned": 0.80, "crypto_constant": 0.70, "linked_library_unpinned": 0.55, "string_literal": 0.40, "filename_metadata": 0.30}
CEILING, FLOOR = 0.99, 0.35
# The policy.
REFERENCE_YEAR = 2026
SCENARIOS = {"optimistic": 20, "median": 14, "pessimistic": 9}
MILESTONES = (("dst-nqm-vendor-cbom", 2027, "all"), ("nist-ir8547-deprecated", 2030, "quantum_vulnerable_112"), ("nist-ir8547-disallowed", 2035, "quantum_vulnerable"))
SHELF_LIFE = {"critical": 25, "high": 15, "medium": 7, "low": 2}
EFFORT_SURFACE = {"tls": 2, "source": 3, "elf": 4, "container": 3}
EFFORT_KIND = {"certificate": 2, "protocol": 2, "algorithm": 3, "related-crypto-material": 4, "library": 3}
EFFORT_DEFAULT = 3
RISK_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "pq-safe": 4}
# Roles that functions imply, and replacements by family and role; the first role is the fallback.
ROLES = {"sign": ("signature",), "verify": ("signature",), "encapsulate": ("kem", "key-agree"), "decapsulate": ("kem", "key-agree"), "keyderive": ("key-agree", "kdf"), "encrypt": ("pke", "block-cipher", "stream-cipher", "ae"), "decrypt": ("pke", "block-cipher", "stream-cipher", "ae"), "digest": ("hash",), "tag": ("mac",)}
REPLACEMENTS = {
    "RSA": {"signature": "ML-DSA-65", "key-agree": "ML-KEM-768", "pke": "ML-KEM-768"}, "ECDSA": {"signature": "ML-DSA-65"}, "EdDSA": {"signature": "ML-DSA-65"}, "DSA": {"signature": "ML-DSA-65"}, "ECDH": {"key-agree": "ML-KEM-768"},
    "X25519": {"key-agree": "ML-KEM-768"}, "DH": {"key-agree": "ML-KEM-768"}, "AES": {"block-cipher": "AES-256"}, "3DES": {"block-cipher": "AES-256"}, "DES": {"block-cipher": "AES-256"}, "RC4": {"stream-cipher": "ChaCha20"},
    "Blowfish": {"block-cipher": "AES-256"}, "MD5": {"hash": "SHA-256"}, "SHA-1": {"hash": "SHA-256"},
}
# Of each replacement by family and role the standard, the hybrid, the alternative and the rationale.
REPLACEMENT_DETAILS = {
    "RSA|signature": ("FIPS 204", None, None, "Lattice signature at NIST level 3; the general-purpose replacement."),
    "RSA|key-agree": ("FIPS 203", "X25519MLKEM768", None, "ML-KEM-768 at NIST level 3; deploy hybrid first per RFC 10024 so a lattice break does not regress security."),
    "RSA|pke": ("FIPS 203", "X25519MLKEM768", None, "RSA key transport has no direct PQ analogue; restructure to a KEM."),
    "ECDSA|signature": ("FIPS 204", None, "SLH-DSA-128s", "Prefer SLH-DSA for firmware and root-of-trust signing: conservative hash-based security, tiny public key, at the cost of a 7856 B signature."),
    "EdDSA|signature": ("FIPS 204", None, "SLH-DSA-128s", None),
    "DSA|signature": ("FIPS 204", None, None, "DSA is already deprecated classically; migrate directly to ML-DSA."),
    "ECDH|key-agree": ("FIPS 203", "X25519MLKEM768", None, None),
    "X25519|key-agree": ("FIPS 203", "X25519MLKEM768", None, None),
    "DH|key-agree": ("FIPS 203", "X25519MLKEM768", None, None),
    "AES|block-cipher": ("FIPS 197", None, None, "Grover halves the effective key length. AES-128 drops to 64-bit quantum security; AES-256 retains 128."),
    "3DES|block-cipher": ("FIPS 197", None, None, "Already disallowed by NIST SP 800-131A Rev.2 after 2023, quantum considerations aside."),
    "DES|block-cipher": ("FIPS 197", None, None, None),
    "RC4|stream-cipher": (None, None, None, "RC4 is prohibited in TLS by RFC 7465."),
    "Blowfish|block-cipher": ("FIPS 197", None, None, None),
    "MD5|hash": ("FIPS 180-4", None, None, "Classically broken; not a quantum issue."),
    "SHA-1|hash": ("FIPS 180-4", None, None, "Classically broken; not a quantum issue."),
}
# What replacements cost in time.
LATENCY = {
    "ML-KEM-768": "Keygen and encapsulation are faster than X25519 in most software stacks; the cost is bytes on the wire, not CPU.",
    "ML-DSA-65": "Signing and verification are competitive with ECDSA; the cost is the 3309 B signature.",
    "SLH-DSA-128s": "Signing is orders of magnitude slower than ECDSA. Acceptable for firmware signed once, not for per-connection use.",
    "X25519MLKEM768": "Adds roughly 1.1 kB to the TLS ClientHello and the same to the server response, which can push the ClientHello past a single MTU.",
}
# Why families are unsound classically.
CLASSICAL_NOTES = {
    "3DES": "Disallowed by NIST SP 800-131A Rev.2 after 2023; 64-bit block invites Sweet32.",
    "DES": "56-bit key, exhaustively searchable.",
    "RC4": "Prohibited in TLS by RFC 7465.",
    "Blowfish": "64-bit block, Sweet32-vulnerable.",
    "MD5": "Practical collisions since 2004.",
    "SHA-1": "SHAttered collision, 2017; disallowed by NIST after 2030.",
}
# Bytes of public key, private key, signature, ciphertext.
SIZES = {
    "RSA-2048": (256, 1190, 256, None), "RSA-3072": (384, 1770, 384, None), "RSA-4096": (512, 2350, 512, None), "ECDSA-P256": (64, 32, 64, None), "ECDSA-P384": (96, 48, 96, None), "ECDSA-P521": (132, 66, 132, None),
    "EdDSA-Ed25519": (32, 32, 64, None), "ECDH-P256": (64, 32, None, 64), "X25519": (32, 32, None, 32), "DH-2048": (256, 256, None, 256), "ML-KEM-512": (800, 1632, None, 768), "ML-KEM-768": (1184, 2400, None, 1088),
    "ML-KEM-1024": (1568, 3168, None, 1568), "ML-DSA-44": (1312, 2560, 2420, None), "ML-DSA-65": (1952, 4032, 3309, None), "ML-DSA-87": (2592, 4896, 4627, None), "SLH-DSA-128s": (32, 64, 7856, None),
    "SLH-DSA-128f": (32, 64, 17088, None), "SLH-DSA-192s": (48, 96, 16224, None), "SLH-DSA-256s": (64, 128, 29792, None), "X25519MLKEM768": (1216, 2432, None, 1120), "SecP256r1MLKEM768": (1249, 2432, None, 1153), "SecP384r1MLKEM1024": (1665, 3216, None, 1665),
}
SIZE_FIELDS = ("public_key", "private_key", "signature", "ciphertext")


def squashed(s: str) -> str:
    return "".join(x for x in s.lower() if x.isascii() and (x.isalnum() or x == "+"))


BY_SQUASH: dict[str, str] = {}
for _a, _f in [*ALIASES.items(), *((f, f) for f in FAMILIES)]:
    BY_SQUASH.setdefault(squashed(_a), _f)


def scale(field: str) -> dict[str, object]:
    """family|parameter to the value of a scale; * stands for any parameter."""
    return {f"{f}|{p}": v for f, e in FAMILIES.items() for p, v in e.get(field, {}).items()}


def of(field: str) -> dict[str, object]:
    return {f: e[field] for f, e in FAMILIES.items() if field in e}


def size_table(field: int) -> dict[str, int]:
    return {squashed(n): row[field] for n, row in SIZES.items() if row[field] is not None}


def _literal(x: object) -> str:
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x!r}D" if isinstance(x, float) else str(x)


def lookup(table: dict, key: Column) -> Column:
    """The value of key in a small table that is a literal of the plan, or null."""
    return F.try_element_at(F.expr("map(" + ", ".join(_literal(x) for pair in table.items() for x in pair) + ")"), key)  # one call for all literals


def sql_lookup(table: dict, key: str) -> str:
    """The same in SQL."""
    show = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "map([" + ", ".join(show(k) for k in table) + "], [" + ", ".join(show(v) for v in table.values()) + f"])[{key}]"
