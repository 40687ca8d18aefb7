"""Free-entered values mapped to a canonical list, by a pigeonhole join in SQL.

The reference strings are spellings of the entries: each combination of family word, size, mode and curve that an entry of the
list has, fully or in part, in each usual order. A value is cleaned to the same form: look-alike letters, case, separators and words of
interfaces go. Values are matched once each, however many rows hold them.

Join: a reference string of length n is cut into K + 1 segments. If a value is within K edits, one segment occurs in it unchanged
and shifted by at most K. So the segments, with n and the digits, are equality keys for the value's substrings at those positions.
Candidates are verified by the built-in levenshtein. Digits must agree, for another number is another algorithm.

A value that no reference string is near to as a whole is matched by windows of its tokens, whatever the words around them are: all
tokens that have a digit or are a reference string themselves must be in the window, and what is left out must not be joined to it by a
hyphen or the like, for that would be a part of the name. Values that have no window either are found by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.session import materialised

#: Edits within which a spelling is near, K if it has 4 * K letters or more, else as many fewer; a swap of neighbours is one edit here.
K = 2
#: Tokens of a window at most; no reference string has more.
WINDOW = 8
#: Letters that a window with edits must have; shorter ones must be right.
LEAST = 5
#: Parts of one value in the join back to the rows, so that a value which many rows hold is spread over tasks.
SALT = 16

#: Letters of other scripts that look like Latin ones, and the Latin ones.
LOOK_ALIKE = (
    "АВЕЅЗІЈКМНОРСТУХЬаеѕіјорсухһԁԛԝгкмнтвӀ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαειοκνρτυχγ",
    "ABES3IJKMHOPCTYXbaesijopcyxhdqwrkmhtbl" "ABEZHIKMNOPTYXaeiokvptuxy",
)
_WIDE = ("".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)))

#: Words for a family that are no alias in the table. The family words are the squashed names.
FAMILY_WORDS = {
    "aes": ("advancedencryptionstandard",), "sha": ("sha2", "securehashalgorithm", "securehashalgorithm2"), "sha3": ("keccak", "securehashalgorithm3"), "des": ("dataencryptionstandard", "singledes"),
    "3des": ("tdes", "desede3", "3tdea", "des3"), "dh": ("dhe", "edh"), "ecdh": ("ecdhe", "ellipticcurvediffiehellman"), "slhdsa": ("sphincs",), "chacha20poly1305": ("chachapoly", "chachapoly1305", "chacha20poly"),
    "chacha20": ("chacha",), "md5": ("messagedigest5",), "sha1": ("securehashalgorithm1",), "rc4": ("rivestcipher4",), "rsa": ("rivestshamiradleman",),
}
#: Words of interfaces and of the trade that are joined to names and say nothing about the algorithm.
FILLERS = (
    "a an the our your my their this that of for by to in with and or algo algorithm alg name type value encryption encrypted encrypt decryption key keys keyed bit bits byte bytes size length len modulus mode modes "
    "curve curves cipher ciphers digest hash hashing function signature signatures sign signing agreement exchange evp crypto cryptography messagedigest message "
    "openssl mbedtls libsodium wolfssl bouncycastle jca jce java go id oid nid nist fips nopadding padding pkcs5padding pkcs7padding pkcs1padding pkcs1 generate gen getinstance get new init "
    "aead stream block suite standard std crystals group groups pair keypair keypairs public private"
).split()
#: Phrases, and what they are short for.
PHRASES = (
    (r"advanced\s+encryption\s+standard", "aes"), (r"data\s+encryption\s+standard", "des"), (r"secure\s+hash(\s+algorithm)?", "sha"),
    (r"galois\W*counter(\s+mode)?", "gcm"), (r"counter\s+with\s+cbc\W*mac", "ccm"), (r"cipher\W*block\W*chaining", "cbc"), (r"electronic\s+code\W*book", "ecb"), (r"\bcounter\b", "ctr"),
    (r"diffie\W*hellman", "diffiehellman"), (r"message\s+digest\s+5", "md5"), (r"nist[\W_]*(?=[pbk][\W_]?\d)", ""), (r"(?<=[a-z0-9])encryption\b", ""), (r"^\W*ec[\W_]+(?=ecd)", ""), (r"\b1\s?k\b", "1024"), (r"\b2\s?k\b", "2048"), (r"\b3\s?k\b", "3072"), (r"\b4\s?k\b", "4096"), (r"(\d)[\s_-]*bits?\b", "$1"),
)


def _squash(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '')"


def _text(s: str) -> str:
    """A literal; braces are doubled for the formatter of spark.sql."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"


def _plain(x: str) -> str:
    """The expression for a value in lower case, without look-alikes and with phrases short."""
    e = f"lower(translate(translate({x}, {_text(_WIDE[0])}, {_text(_WIDE[1])}), {_text(LOOK_ALIKE[0])}, {_text(LOOK_ALIKE[1])}))"
    for pattern, to in PHRASES:
        e = f"regexp_replace({e}, {_text(pattern)}, {_text(to)})"
    return e


_FILLERS = f"array({', '.join(map(_text, FILLERS))})"


def _bare(x: str) -> str:
    """The expression for a cleaned value."""
    return f"array_join(filter(split({_plain(x)}, '[^a-z0-9]+'), t -> t <> '' AND NOT array_contains({_FILLERS}, t)), '')"


def _real(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) RLIKE '[a-z0-9]' THEN lower(trim({x})) END"


def reference_strings(spark: SparkSession, algorithms: DataFrame, aliases: DataFrame) -> DataFrame:
    """kind, spelling, word, size, mode, curve, primitive: every spelling of every entry in whole or in part.

    A table of the order of the list of entries, some dozens of spellings for each; the list is fixed.
    """
    extra = ", ".join(f"({_text(w)}, {_text(s)})" for w, ss in FAMILY_WORDS.items() for s in ss)
    spec = spark.sql(
        f"""
        WITH entry AS (
          SELECT entry_id, name, family, primitive, CAST(key_size AS STRING) AS size, mode, curve, {_squash("name")} AS bare FROM {{algorithms}} WHERE entry_kind = 'algorithm'),
        cut1 AS (SELECT *, CASE WHEN mode IS NOT NULL AND endswith(bare, mode) THEN left(bare, length(bare) - length(mode)) ELSE bare END AS b1 FROM entry),
        cut2 AS (SELECT *, CASE WHEN curve IS NOT NULL AND endswith(b1, {_squash("curve")}) THEN left(b1, length(b1) - length({_squash("curve")})) ELSE b1 END AS b2 FROM cut1)
        SELECT *, CASE WHEN size IS NOT NULL AND endswith(b2, size) THEN left(b2, length(b2) - length(size)) ELSE b2 END AS word, max(name = family) OVER (PARTITION BY family) AS headed FROM cut2
        """,
        algorithms=algorithms,
    )
    spec = materialised(spec.coalesce(1))  # one row for each entry
    named = spark.sql(
        f"""
        SELECT s.*, {_squash("a.alias")} AS w, a.canonical = s.name AS whole, a.alias FROM (
          SELECT *, key FROM {{spec}} LATERAL VIEW explode(array_distinct(array(family, name))) k AS key) s
        JOIN {{aliases}} a ON a.entry_kind = 'algorithm' AND a.canonical = s.key
        """,
        spec=spec,
        aliases=aliases,
    )
    named = materialised(named.coalesce(1))  # one row for each alias and entry it is about
    return spark.sql(
        f"""
        WITH curve_words AS (
          SELECT name AS curve, {_squash("name")} AS w FROM {{algorithms}} WHERE entry_kind = 'curve'
          UNION SELECT canonical, {_squash("alias")} FROM {{aliases}} WHERE entry_kind = 'curve'),
        words AS (
          SELECT word, array_distinct(flatten(collect_list(ws))) AS ws FROM (
            SELECT word, array(word) AS ws FROM {{spec}}
            UNION ALL SELECT word, array(w) FROM {{named}} WHERE IF(whole, size IS NULL AND mode IS NULL AND curve IS NULL, size IS NOT NULL AND NOT headed)
            UNION ALL SELECT word, array(left(w, length(w) - length(size))) FROM {{named}} WHERE whole AND endswith(alias, size)
            UNION ALL SELECT word, array(w) FROM VALUES {extra} AS t(word, w)) GROUP BY word),
        parts AS (
          SELECT DISTINCT word, primitive, IF(ds, NULL, size) AS size, IF(dm, NULL, mode) AS mode, IF(dc, NULL, curve) AS curve
          FROM {{spec}} LATERAL VIEW explode(array(true, false)) s AS ds LATERAL VIEW explode(array(true, false)) m AS dm LATERAL VIEW explode(array(true, false)) c AS dc),
        spelled AS (
          SELECT p.word, p.primitive, p.size, p.mode, p.curve, f, coalesce(p.size, '') AS s, coalesce(p.mode, '') AS m, coalesce(c.w, '') AS k
          FROM parts p JOIN words w ON p.word = w.word LEFT JOIN curve_words c ON p.curve = c.curve LATERAL VIEW explode(w.ws) x AS f)
        SELECT DISTINCT * FROM (
          SELECT 'algorithm' AS kind, spelling, word, size, mode, curve, primitive FROM spelled
            LATERAL VIEW explode(array(concat(f, s, m, k), concat(f, m, s, k), concat(m, f, s, k), concat(s, f, m, k), concat(s, m, f, k), concat(m, s, f, k), concat(k, f, s, m))) o AS spelling
          UNION ALL SELECT 'algorithm', w, word, size, mode, curve, primitive FROM {{named}} WHERE whole
          UNION ALL SELECT 'algorithm', concat('eddsa', bare), word, size, mode, curve, primitive FROM {{spec}} WHERE family = 'EdDSA'
          UNION ALL SELECT 'curve', w, NULL, NULL, NULL, curve, NULL FROM curve_words)
        """,
        algorithms=algorithms,
        aliases=aliases,
        spec=spec,
        named=named,
    )


def match_values(spark: SparkSession, values: DataFrame, references: DataFrame) -> DataFrame:
    """kind, bare, spelling, distance: each distinct (kind, bare) of values with the reference strings nearest to it.

    distance is the number of edits, of which a swap of neighbours is one. Values without a near string have no row.
    """
    segments = spark.sql(
        f"""
        SELECT kind, spelling, n, i, start, substr(spelling, start, stop - start) AS segment, regexp_replace(spelling, '[^0-9]', '') AS digits FROM (
          SELECT kind, spelling, n, i, 1 + i * n DIV {K + 1} AS start, 1 + (i + 1) * n DIV {K + 1} AS stop
          FROM (SELECT DISTINCT kind, spelling, length(spelling) AS n FROM {{references}}) LATERAL VIEW explode(sequence(0, {K})) e AS i)
        """,
        references=references,
    )
    return spark.sql(
        f"""
        WITH probe AS (
          SELECT DISTINCT kind, bare, n, i, substr(bare, start, len) AS segment, digits FROM (
            SELECT kind, bare, n, i, digits, 1 + i * n DIV {K + 1} + shift AS start, (i + 1) * n DIV {K + 1} - i * n DIV {K + 1} AS len
            FROM (SELECT DISTINCT kind, bare, regexp_replace(bare, '[^0-9]', '') AS digits FROM {{values}} WHERE bare <> '')
            LATERAL VIEW explode(sequence(greatest(1, length(bare) - {K}), length(bare) + {K})) a AS n
            LATERAL VIEW explode(sequence(0, {K})) b AS i LATERAL VIEW explode(sequence(-{K}, {K})) c AS shift)
          WHERE start >= 1 AND start + len - 1 <= length(bare)),
        candidate AS (
          SELECT DISTINCT p.kind, p.bare, s.spelling FROM probe p JOIN {{segments}} s ON p.kind = s.kind AND p.n = s.n AND p.i = s.i AND p.segment = s.segment AND p.digits = s.digits),
        verified AS (
          SELECT kind, bare, spelling, levenshtein(bare, spelling) AS edits FROM candidate WHERE levenshtein(bare, spelling, {K}) >= 0),
        swapped AS (
          SELECT kind, bare, spelling, IF(edits = 2 AND length(bare) = length(spelling) AND exists(sequence(1, length(bare) - 1), j -> concat(left(bare, j - 1), substr(bare, j + 1, 1), substr(bare, j, 1), substr(bare, j + 2)) = spelling), 1, edits) AS distance FROM verified),
        near AS (SELECT * FROM swapped WHERE distance <= 1 OR length(spelling) >= 4 * distance)
        SELECT kind, bare, spelling, distance FROM (SELECT *, min(distance) OVER (PARTITION BY kind, bare) AS least FROM near) WHERE distance = least
        """,
        values=values,
        segments=segments,
    )


def windows(spark: SparkSession, values: DataFrame, references: DataFrame) -> DataFrame:
    """id, bare, coded of the best window of each of values (id, kind, plain): of those within an edit the longest, else the longest within K.

    coded: a word without vowels, as modes are, is left out. A value without a window has no row.
    """
    tokens = spark.sql(
        f"""
        WITH token AS (
          SELECT id, kind, pos, regexp_extract(piece, '^[a-z0-9]+', 0) AS t, piece RLIKE '[a-z0-9][-_/.]$' AS joined
          FROM {{values}} LATERAL VIEW posexplode(regexp_extract_all(plain, '([a-z0-9]+[^a-z0-9]*)', 1)) x AS pos, piece),
        known AS (SELECT DISTINCT kind, spelling FROM {{references}} UNION SELECT DISTINCT 'algorithm', mode FROM {{references}} WHERE mode IS NOT NULL UNION SELECT DISTINCT 'algorithm', spelling FROM {{references}} WHERE kind = 'curve'),
        marked AS (
          SELECT id, t.kind, pos, t, joined, array_contains({_FILLERS}, t) AS filler, t RLIKE '[0-9]' OR k.spelling IS NOT NULL AS hard, t RLIKE '^[b-df-hj-np-tv-xz]{{{{2,4}}}}$' AND k.spelling IS NULL AS code
          FROM token t LEFT JOIN known k ON t.kind = k.kind AND t.t = k.spelling)
        SELECT id, kind, ts, size(ts) AS n, array_min(transform(filter(ts, x -> x.hard AND NOT x.filler), x -> x.pos)) AS lo, array_max(transform(filter(ts, x -> x.hard AND NOT x.filler), x -> x.pos)) AS hi, size(filter(ts, x -> x.code)) AS codes
        FROM (SELECT id, kind, array_sort(collect_list(struct(pos, t, joined, filler, hard, code))) AS ts FROM marked GROUP BY id, kind)
        """,
        values=values,
        references=references,
    )
    tried = spark.sql(
        f"""
        WITH span AS (
          SELECT * FROM (
            SELECT id, kind, ts, codes, i, j FROM {{tokens}} LATERAL VIEW explode(sequence(greatest(0, coalesce(hi - {WINDOW - 1}, 0)), coalesce(lo, n - 1))) a AS i
              LATERAL VIEW explode(sequence(greatest(i, coalesce(hi, i)), least(i + {WINDOW - 1}, n - 1))) b AS j WHERE hi - lo < {WINDOW} OR lo IS NULL)
          WHERE NOT ts[i].filler AND NOT ts[j].filler AND (i = 0 OR NOT ts[i - 1].joined OR ts[i - 1].filler) AND (j = size(ts) - 1 OR NOT ts[j].joined OR ts[j + 1].filler)),
        word AS (SELECT id, kind, i, codes, filter(slice(ts, i + 1, j - i + 1), x -> NOT x.filler) AS w FROM span),
        form AS (
          SELECT id, kind, i, codes, explode(array_distinct(array(w, filter(w, (x, k) -> x.hard OR x.joined OR (k > 0 AND w[k - 1].joined))))) AS w FROM word)
        SELECT id, kind, i, array_join(transform(w, x -> x.t), '') AS bare, codes > size(filter(w, x -> x.code)) AS coded FROM form WHERE size(w) > 0
        """,
        tokens=tokens,
    )
    tried = materialised(tried)
    return spark.sql(
        f"""
        SELECT id, min_by(bare, o) AS bare, min_by(coded, o) AS coded FROM (
          SELECT t.id, t.bare, t.coded, struct(n.distance > 1, -length(t.bare), n.distance, t.i) AS o FROM {{tried}} t JOIN {{near}} n ON t.kind = n.kind AND t.bare = n.bare WHERE n.distance = 0 OR length(t.bare) >= {LEAST}) GROUP BY id
        """,
        tried=tried,
        near=match_values(spark, tried.select("kind", "bare").distinct(), references),
    )


def map_values(spark: SparkSession, rows: DataFrame, algorithms: DataFrame, aliases: DataFrame) -> DataFrame:
    """The distinct (kind, value, key_size, mode, curve, primitive) of rows with entry_id and distance; -1 where none is meant.

    A null in key_size, mode, curve or primitive, or a stand-in for a value, says nothing. What the value states goes before what the
    other columns state. Of equally near spellings the one that agrees with primitive, then with the other columns, then the
    lowest entry_id is taken. Blank values and values of other algorithms are unmatched. No value is left out.
    """
    references = materialised(reference_strings(spark, algorithms, aliases))
    combos = spark.sql(
        f"""
        SELECT monotonically_increasing_id() AS id, *, {_bare("value")} AS bare, {_bare("curve")} AS bare_curve FROM (
          SELECT DISTINCT kind, value, regexp_extract({_real("key_size")}, '^([0-9]+)$', 1) AS key_size, {_real("mode")} AS mode, curve, primitive FROM {{rows}})
        """,
        rows=rows.select("kind", "value", "key_size", "mode", "curve", "primitive"),
    )
    combos = materialised(combos)  # one row for each distinct value, used three times
    wanted = spark.sql("SELECT kind, bare FROM {combos} UNION SELECT 'curve', bare_curve FROM {combos} WHERE kind = 'algorithm' AND bare_curve <> ''", combos=combos)
    near = materialised(match_values(spark, wanted, references).filter("distance <= 1"))
    missed = spark.sql(f"SELECT id, kind, {_plain('value')} AS plain FROM {{combos}} c LEFT ANTI JOIN {{near}} n ON c.kind = n.kind AND c.bare = n.bare", combos=combos, near=near)
    found = materialised(windows(spark, missed, references))
    combos = materialised(spark.sql("SELECT c.id, kind, value, key_size, mode, curve, primitive, coalesce(w.bare, c.bare) AS bare, bare_curve, coalesce(coded, false) AS coded FROM {combos} c LEFT JOIN {found} w ON c.id = w.id", combos=combos, found=found))
    again = spark.sql("SELECT DISTINCT c.kind, c.bare FROM {found} w JOIN {combos} c ON w.id = c.id", combos=combos, found=found)
    # aggregated first: of a checkpoint, a union can't carry over the constraints on columns that it no longer has
    near = materialised(near.distinct().unionByName(match_values(spark, again, references)).distinct())
    matched = spark.sql(
        """
        WITH curves AS (
          SELECT n.bare, min(r.curve) AS curve FROM {near} n JOIN {references} r ON n.kind = 'curve' AND r.kind = 'curve' AND n.spelling = r.spelling GROUP BY n.bare),
        spec AS (
          SELECT a.entry_id, r.word, r.size, r.mode, r.curve FROM {algorithms} a JOIN {references} r
            ON r.kind = 'algorithm' AND a.entry_kind = 'algorithm' AND regexp_replace(lower(a.name), '[^a-z0-9]', '') = r.spelling AND CAST(a.key_size AS STRING) <=> r.size AND a.mode <=> r.mode AND a.curve <=> r.curve
          UNION ALL SELECT entry_id, NULL, NULL, NULL, name FROM {algorithms} WHERE entry_kind = 'curve'),
        families AS (SELECT word, count(size) > 0 AS has_size, count(mode) > 0 AS has_mode, count(curve) > 0 AS has_curve, collect_list(struct(size, mode, curve, entry_id)) AS entries FROM spec GROUP BY word),
        read AS (
          SELECT c.id, c.primitive, c.key_size, c.mode, c.coded AND d.has_mode AS other_mode, k.curve AS own_curve, n.distance, r.size AS r_size, r.mode AS r_mode, r.curve AS r_curve, r.primitive AS r_primitive, d.entries,
            coalesce(r.size, IF(d.has_size, nullif(c.key_size, ''), NULL)) AS f_size, coalesce(r.mode, IF(d.has_mode, c.mode, NULL)) AS f_mode, coalesce(r.curve, IF(d.has_curve AND c.kind = 'algorithm', k.curve, NULL)) AS f_curve
          FROM {combos} c JOIN {near} n ON c.kind = n.kind AND c.bare = n.bare JOIN {references} r ON r.kind = n.kind AND r.spelling = n.spelling
            JOIN families d ON r.word <=> d.word LEFT JOIN curves k ON c.bare_curve = k.bare),
        hit AS (
          SELECT *, e.entry_id, IF(e.size <=> f_size AND e.mode <=> f_mode AND e.curve <=> f_curve, 0, 1) AS less FROM read LATERAL VIEW explode(entries) x AS e
          WHERE NOT other_mode AND (e.size <=> f_size OR e.size <=> r_size) AND (e.mode <=> f_mode OR e.mode <=> r_mode) AND (e.curve <=> f_curve OR e.curve <=> r_curve))
        SELECT id, min(distance) AS distance,
          min_by(entry_id, struct(less, IF(primitive = r_primitive, 0, 1), IF(nullif(key_size, '') = r_size, 0, 1) + IF(mode = r_mode, 0, 1) + IF(own_curve = r_curve, 0, 1), entry_id)) AS entry_id
        FROM hit GROUP BY id
        """,
        near=near,
        references=references,
        combos=combos,
        algorithms=algorithms,
    )
    matched = materialised(matched)
    return spark.sql(
        """
        SELECT kind, value, key_size, mode, curve, primitive, entry_id, distance FROM {combos} c JOIN {matched} m ON c.id = m.id
        UNION ALL SELECT kind, value, key_size, mode, curve, primitive, -1, CAST(NULL AS INT) FROM {combos} c LEFT ANTI JOIN {matched} m ON c.id = m.id
        """,
        matched=matched,
        combos=combos,
    )


def typed_values(spark: SparkSession, findings: DataFrame, source_rules: DataFrame, algorithms: DataFrame) -> DataFrame:
    """The values that aren't literally a name of their kind: table_name, row_key, field, kind, value, key_size, mode, curve, primitive."""
    return spark.sql(
        """
        WITH said AS (
          SELECT 'findings' AS table_name, seq AS row_key, IF(asset_kind = 'algorithm', name, NULL) AS name, 'name' AS name_field, parameters AS p, primitive FROM {findings}
          UNION ALL SELECT 'source_rules', rule_id, algorithm, 'algorithm', parameters, NULL FROM {source_rules}),
        typed AS (
          SELECT table_name, row_key, t.field, t.kind, t.value, try_element_at(p, 'key_size') AS key_size, try_element_at(p, 'mode') AS mode, try_element_at(p, 'curve') AS curve, primitive
          FROM said LATERAL VIEW explode(array(named_struct('field', name_field, 'kind', 'algorithm', 'value', name), named_struct('field', 'curve', 'kind', 'curve', 'value', try_element_at(p, 'curve')))) e AS t
          WHERE t.value IS NOT NULL)
        SELECT table_name, row_key, field, kind, value, IF(kind = 'algorithm', key_size, NULL) AS key_size, IF(kind = 'algorithm', mode, NULL) AS mode, IF(kind = 'algorithm', curve, NULL) AS curve,
          IF(kind = 'algorithm', nullif(primitive, 'unknown'), NULL) AS primitive
        FROM typed LEFT ANTI JOIN (SELECT entry_kind, name FROM {algorithms}) a ON typed.kind = a.entry_kind AND typed.value = a.name
        """,
        findings=findings,
        source_rules=source_rules,
        algorithms=algorithms,
    )


def mapped(spark: SparkSession, findings: DataFrame, source_rules: DataFrame, algorithms: DataFrame, aliases: DataFrame) -> DataFrame:
    """table_name, row_key, field, entry_id of every typed value."""
    rows = typed_values(spark, findings, source_rules, algorithms)
    mapping = map_values(spark, rows, algorithms, aliases)
    keys = ("kind", "value", "key_size", "mode", "curve", "primitive")
    plain = rows.select("table_name", "row_key", "field", "kind", "value", F.expr(f"regexp_extract({_real('key_size')}, '^([0-9]+)$', 1)").alias("key_size"), F.expr(_real("mode")).alias("mode"), "curve", "primitive", F.pmod(F.xxhash64("row_key"), F.lit(SALT)).alias("salt"))
    salted = mapping.select(*[F.col(k).alias(f"m_{k}") for k in keys], "entry_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("m_salt"))
    on = F.col("salt") == F.col("m_salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"m_{k}"))
    return plain.join(salted, on).select("table_name", "row_key", "field", F.col("entry_id").cast("int").alias("entry_id"))


def unmatched_values(spark: SparkSession, findings: DataFrame, source_rules: DataFrame, algorithms: DataFrame, aliases: DataFrame) -> DataFrame:
    """kind, value, n_values: the values without an entry, with the number of combinations they came in."""
    rows = typed_values(spark, findings, source_rules, algorithms)
    return map_values(spark, rows, algorithms, aliases).filter("entry_id = -1").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_values"))
