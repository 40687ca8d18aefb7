"""Source files that don't parse, and their rates for each target and language.

A file of C, C++, Java or Go is cut at line starts into chunks. A chunk is represented by its lexer-state map, what it does to each state
it may be entered in, with bracket summaries. Maps compose associatively. A file's composed map rejects it if it ends within a comment or
string or, where no preprocessor chooses between branches, has unbalanced brackets; what is balanced is parsed by the local grammars.

A file of one chunk is decided where it is read: it is entered in code, so its map is that of code alone. The chunks of other files are
rows of their own, and their maps are reduced in blocks of FAN, then the blocks. Python and JSON are read by the interpreter's parsers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm import grammars, lexers

#: Bytes of a chunk, which goes on to the end of its line.
CHUNK = 1 << 12
#: Chunks whose maps are composed in one step; with two levels a file has up to FAN * FAN chunks.
FAN = 512


def language(path: Column) -> Column:
    """The language that a path's suffix says, in any case of letters; null if it says none."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    out = F.lit(None).cast("string")
    for s, lang in lexers.LANGUAGE.items():
        out = F.when(suffix == s, lang).otherwise(out)
    return out


def cut(content: bytes, size: int) -> list[bytes]:
    """content in chunks that begin at line starts, where neither a line is continued nor a directive has just been read."""
    out, at = [], 0
    while len(content) - at > size:
        end = at + size
        while True:
            end = content.find(b"\n", end) + 1
            if not end:
                end = len(content)
                break
            line = content[content.rfind(b"\n", 0, end - 1) + 1 : end].rstrip(b"\r\n")
            if not line.endswith(b"\\") and not line.lstrip().startswith(b"#"):
                break
        out.append(content[at:end])
        at = end
    return [*out, content[at:]]


def verdicts(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """file_id, target_id, lang, rejected: one row for each file with a known suffix, whatever its length column says.

    A null content is an empty file. A null path has no language and so no row.
    """
    rows = files.select("file_id", "target_id", language(F.col("path")).alias("lang"), F.coalesce("content", F.lit(b"")).alias("content")).filter("lang IS NOT NULL")
    kind = dict(rows.dtypes)["file_id"]
    schema = f"file_id {kind}, target_id string, lang string, rejected boolean"
    parts = (F.length("content") > chunk) & ~F.col("lang").isin("python", "json")
    return rows.filter(~parts).mapInPandas(_one_chunk, schema).unionByName(_in_chunks(rows.filter(parts), chunk, schema, kind))


def _deep() -> None:
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4000))


def balanced(lang: str, left: str | None, closing: str, opening: str, wrong: bool) -> bool:
    """Whether a file's composed map, entered in code, leaves its grammar something to decide.

    No exit state is known of a file in which a raw string of C++ goes over a chunk's end.
    """
    return left is None or (left == "code" and (lang in ("c", "cpp") or not (wrong or closing or opening)))


def _rejects(lang: str, content: bytes) -> bool:
    """Whether a file is rejected: by the map of the state code, else by the grammar."""
    if lang in ("python", "json"):
        return not grammars.accepts(lang, content)
    text = grammars.decoded(lang, content)
    if text is None:
        return True
    tokens, left = lexers.lex(lang, text)
    if left != "code" or (lang in ("java", "go") and not balanced(lang, left, *lexers.summary(tokens))):
        return True
    return not grammars.accepts_tokens(lang, tokens)


def _one_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    _deep()
    for pdf in batches:
        open_ = pdf["open"] if "open" in pdf else [True] * len(pdf)
        bad = [not o or _rejects(lang, bytes(c)) for lang, c, o in zip(pdf["lang"], pdf["content"], open_)]
        yield pd.DataFrame({"file_id": pdf["file_id"], "target_id": pdf["target_id"], "lang": pdf["lang"], "rejected": pd.Series(bad, dtype=bool, index=pdf.index)})


def _in_chunks(rows: DataFrame, chunk: int, schema: str, kind: str) -> DataFrame:
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(f, lang, i, c) for f, lang, content in zip(pdf["file_id"], pdf["lang"], pdf["content"]) for i, c in enumerate(cut(bytes(content), chunk))]
            yield pd.DataFrame(out, columns=["file_id", "lang", "part", "content"])

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, c, p in zip(pdf["lang"], pdf["content"], pdf["part"]):
                text = grammars.decoded(lang, bytes(c)) if p == 0 else _decoded_rest(lang, bytes(c))
                out.append("null" if text is None else json.dumps(lexers.chunk_map(lang, text, ("code",) if p == 0 else None)))
            yield pd.DataFrame({"file_id": pdf["file_id"], "lang": pdf["lang"], "part": pdf["part"], "map": pd.Series(out, dtype=object)})

    def composed(ms) -> dict | None:
        """The map of neighbouring chunks; None if one is no text of the language."""
        own = [json.loads(m["map"]) for m in ms]
        return None if None in own else reduce(lexers.compose, own)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file_id": pdf["file_id"], "lang": pdf["lang"], "part": pdf["block"], "map": pd.Series([json.dumps(composed(ms)) for ms in pdf["maps"]], dtype=object)})

    def outcome(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [composed(ms) for ms in pdf["maps"]]
            yield pd.DataFrame({"file_id": pdf["file_id"], "open": pd.Series([m is not None and balanced(lang, *m["code"]) for lang, m in zip(pdf["lang"], own)], dtype=bool)})

    chunks = rows.mapInPandas(split, f"file_id {kind}, lang string, part int, content binary").repartition("file_id", "part")
    of = F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps")
    step = f"file_id {kind}, lang string, part int, map string"
    blocks = chunks.mapInPandas(maps, step).groupBy("file_id", "lang", F.expr(f"part DIV {FAN}").cast("int").alias("block")).agg(of)
    known = blocks.mapInPandas(total, step).groupBy("file_id", "lang").agg(of).mapInPandas(outcome, f"file_id {kind}, open boolean")
    return rows.join(known, "file_id").mapInPandas(_one_chunk, schema)


def _decoded_rest(lang: str, content: bytes) -> str | None:
    """The text of a chunk that isn't a file's first: a byte order mark is no mark there."""
    text = grammars.decoded(lang, b"\n" + content)
    return None if text is None else text[1:]


def rejected(files: DataFrame) -> DataFrame:
    return verdicts(files).filter("rejected").select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """target_id, lang, files, rejected, rate: of each target (null is one) and language. Rates have six places."""
    got = verdicts(files).groupBy("target_id", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("rejected").cast("bigint")).alias("rejected"))
    return got.withColumn("rate", F.round(F.col("rejected") / F.col("files"), 6))


