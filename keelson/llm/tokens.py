"""Encoding with a public tokenizer by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap, each a row of its own. Chunks are pre-tokenised in parallel. Left of a
chunk's own start its pre-token boundaries may be wrong, but the pre-tokeniser looks only ahead, so from the first boundary on which
two neighbours agree both are right: there they are stitched. The pieces between stitches are encoded in parallel and joined in
order. Neighbours that agree nowhere in their overlap, as within one endless word, are encoded as one piece.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a chunk, and of the overlap on its left. A text of one chunk has nothing to be stitched.
CHUNK, OVERLAP = 8_192, 512
#: Fixed value: where vocabulary files of public tokenizers are.
FOLDER = "/opt/tokenizers"
#: Fixed value: the pre-tokeniser's pattern that goes with the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def byte_bpe(path: str):
    """A tiktoken encoding of a rank file, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def encoder(name: str, folder: str = FOLDER):
    """A function from texts to lists of ids, without special tokens; strings that look like special tokens are ordinary text."""
    if name.startswith("byte_bpe"):
        bpe = byte_bpe(f"{folder}/{name}.tiktoken")
        return lambda texts: [bpe.encode_ordinary(t) for t in texts]
    if name.startswith("word_bpe"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(f"{folder}/{name}.json")
        tok.encode_special_tokens = True
        return lambda texts: [e.ids for e in tok.encode_batch(list(texts), add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
    return lambda texts: [sp.encode(t, num_threads=1) for t in texts]


def decode(ids: list[int], path: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> bytes:
    """The raw bytes of ids, those of each token one after the other."""
    return byte_bpe(path).decode_bytes(ids)


@functools.cache
def _pattern():
    import regex

    return regex.compile(PATTERN)


@functools.cache
def _certain():
    """Places that no pre-token spans, whatever stands before: the class changes, and neither a blank nor an apostrophe leads over."""
    import regex

    return regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")


def boundaries(text: str, lo: int, hi: int) -> list[int]:
    """Starts in [lo, hi) of the pre-tokens of text that hold whatever precedes it, without the last two, which what follows could change.

    A chunk's neighbour may itself have begun within a pre-token, so that both agree is not enough.
    """
    return _within(text, [m.start() for m in _pattern().finditer(text)], lo, hi)


def _within(text: str, starts: list[int], lo: int, hi: int) -> list[int]:
    return [s for s in starts[:-2] if lo <= s < hi and (s == 0 or _certain().match(text, s))]


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key and ids, one row for each row of df; key must be unique. Null and empty texts give an empty list."""
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["k"]
    step = chunk - overlap
    short = rows.filter(F.length("t") <= chunk)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = encoder(name, folder)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "part": pdf["part"], "ids": pd.Series(run(pdf["t"]), index=pdf.index, dtype=object)})

    whole = short.withColumn("part", F.lit(0)).select("k", "part", "t").mapInPandas(encode, f"k {kind}, part int, ids array<int>").select("k", "ids")
    if not name.startswith("byte_bpe"):  # the others' pre-tokens aren't known here: a text is one piece
        rest = rows.filter(F.length("t") > chunk).withColumn("part", F.lit(0)).select("k", "part", "t").mapInPandas(encode, f"k {kind}, part int, ids array<int>").select("k", "ids")
        return whole.unionByName(rest).select(F.col("k").alias(key), "ids")
    long = rows.filter(F.length("t") > chunk)
    cut = long.select("k", "t", F.posexplode(F.sequence(F.lit(0), F.length("t") - 1, F.lit(step))).alias("part", "base"))
    # each chunk reaches an overlap beyond where the next one starts
    cut = cut.select("k", "part", F.expr(f"substring(t, base + 1, {chunk})").alias("t")).repartition("k", "part")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            starts = [[m.start() for m in _pattern().finditer(t)] for t in pdf["t"]]
            pdf["head"] = [_within(t, s, 0 if p == 0 else 1, overlap) for t, s, p in zip(pdf["t"], starts, pdf["part"])]
            pdf["tail"] = [[b - step for b in _within(t, s, step, step + overlap)] for t, s in zip(pdf["t"], starts)]
            yield pdf

    marked = cut.mapInPandas(mark, f"k {kind}, part int, t string, head array<int>, tail array<int>")
    by = Window.partitionBy("k").orderBy("part")
    joint = marked.withColumn("from", F.when(F.col("part") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by)))))
    joint = joint.withColumn("next", F.lead("part").over(by)).withColumn("to", F.lead("from").over(by))
    # a chunk that joins its predecessor nowhere goes on with it: its piece starts where the predecessor's chunk ends its step
    piece = joint.select(
        "k", "part", F.sum(F.col("from").isNotNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("piece"),
        F.expr(f"substring(t, coalesce(from, 0) + 1, CASE WHEN next IS NULL THEN length(t) ELSE {step} + coalesce(to, 0) - coalesce(from, 0) END)").alias("t"),
    )
    texts = piece.groupBy("k", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda x: x["t"]), "").alias("t"))
    parts = texts.select("k", F.col("piece").cast("int").alias("part"), "t").mapInPandas(encode, f"k {kind}, part int, ids array<int>")
    joined = parts.groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.unionByName(joined).select(F.col("k").alias(key), "ids")


def n_tokens(ids: Column) -> Column:
    return F.size(ids)
