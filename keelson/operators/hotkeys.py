"""Per-key results where a handful of keys hold most rows.

Each input split dictionary-encodes its keys and counts them with bincount into dense accumulator arrays, cut into blocks by a hash of
the key. A split sends one array slot for each of its keys, however many rows a key has, and blocks are summed in two rounds, each
array position by itself. So counts need no shuffle of rows at all. Where distinct assets are counted too, rows are first made one for
each key and asset, by a shuffle on both together that the keys' skew doesn't touch, and these are the splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots that a block has on average at most, so that a block of the final sum fits in a task whatever the number of keys.
BLOCK_SLOTS = 4096
#: Partial sums of neighbouring splits that one task of the first round takes for a block.
FAN_IN = 512
#: Distinct keys that a split holds before it sends them on.
HELD = 1 << 18
_PARTIAL = "block int, fan int, fields array<string>, keys array<string>, sightings array<bigint>, assets array<bigint>, latest array<bigint>"
_LOWEST = np.iinfo(np.int64).min


def _reduce(field: np.ndarray, key: np.ndarray, sightings: np.ndarray, assets: np.ndarray, latest: np.ndarray):
    """Dense sums over the distinct keys: a dictionary code for each row, then one scatter-reduction for each array."""
    codes, uniques = pd.factorize(pd.MultiIndex.from_arrays([field, key])) if len(field) else (np.empty(0, int), [])
    n = len(uniques)
    sums = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, _LOWEST, np.int64)]
    np.add.at(sums[0], codes, sightings)
    np.add.at(sums[1], codes, assets)
    np.maximum.at(sums[2], codes, latest)
    return np.array([u[0] for u in uniques], object), np.array([u[1] for u in uniques], object), sums


def _blocks(field: np.ndarray, key: np.ndarray, sums: list, n_blocks: int, fan: int) -> pd.DataFrame:
    block = (pd.util.hash_array(key.astype(object)) % np.uint64(n_blocks)).astype(np.int32) if len(key) else np.empty(0, np.int32)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1)) if len(order) else np.empty(0, int)
    rows = []
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        at = order[lo:hi]
        rows.append((int(block[at[0]]), fan, field[at], key[at], *[s[at] for s in sums]))
    return pd.DataFrame(rows, columns=["block", "fan", "fields", "keys", "sightings", "assets", "latest"])


def _n_blocks(df: DataFrame, fields: Sequence[str]) -> int:
    """So many blocks that one has about BLOCK_SLOTS keys, by an estimate of the number of keys."""
    about = df.agg(*[F.approx_count_distinct(F.col(f).cast("string"), 0.1) for f in fields]).first()
    return max(16, -(-2 * sum(about) // BLOCK_SLOTS))


def _summed(partial: DataFrame) -> DataFrame:
    """field, key_value, sightings, assets, latest: the blocks of all splits added up."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.concatenate(pdf[c].to_list()) for c in ("fields", "keys", "sightings", "assets", "latest")]
        f, k, sums = _reduce(*parts)
        return pd.DataFrame([(pdf["block"].iat[0], -1, f, k, *sums)], columns=["block", "fan", "fields", "keys", "sightings", "assets", "latest"])

    summed = partial.groupBy("block", "fan").applyInPandas(add, _PARTIAL).groupBy("block").applyInPandas(add, _PARTIAL)
    row = F.explode(F.arrays_zip("fields", "keys", "sightings", "assets", "latest")).alias("r")
    return summed.select(row).select(
        F.col("r.fields").alias("field"), F.col("r.keys").alias("key_value"), "r.sightings", "r.assets",
        F.when(F.col("r.latest") > _LOWEST, F.timestamp_micros("r.latest").cast("timestamp_ntz")).alias("latest"),
    )


def _fan() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() // FAN_IN


def key_counts(df: DataFrame, fields: Sequence[str], n_blocks: int | None = None) -> DataFrame:
    """field, key_value, sightings: the rows of each value, that isn't null, of each field. Values are taken literally."""
    n_blocks = n_blocks or _n_blocks(df, fields)
    names = list(fields)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fan = _fan()
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]
        size = 0

        def blocks() -> Iterator[pd.DataFrame]:
            for name, own in zip(names, held):
                if own:
                    codes, keys = pd.factorize(np.concatenate([k for k, _ in own]))
                    n = np.zeros(len(keys), np.int64)
                    np.add.at(n, codes, np.concatenate([c for _, c in own]))
                    yield _blocks(np.full(len(keys), name, object), np.asarray(keys, object), [n, np.zeros_like(n), np.full_like(n, _LOWEST)], n_blocks, fan)
                own.clear()

        for pdf in batches:
            for i, own in enumerate(held):
                codes, keys = pd.factorize(pdf[f"k{i}"])
                if len(keys):
                    own.append((np.asarray(keys, object), np.bincount(codes[codes >= 0], minlength=len(keys)).astype(np.int64)))
                    size += len(keys)
            if size > HELD:
                yield from blocks()
                size = 0
        yield from blocks()

    cols = df.select(*[F.col(f).cast("string").alias(f"k{i}") for i, f in enumerate(names)])
    return _summed(cols.mapInPandas(split, _PARTIAL)).select("field", "key_value", "sightings")


def key_totals(df: DataFrame, fields: Sequence[str], asset: Sequence[str], when: str, n_blocks: int | None = None) -> DataFrame:
    """field, key_value, sightings, assets, latest: for each field of fields and each value of it that isn't null.

    assets counts the distinct values of the columns asset, of which the last must not be null; latest is the highest of when, a
    timestamp, or null. Values are taken literally, an empty string is a value. An empty table gives no rows.
    """
    n_blocks = n_blocks or _n_blocks(df, fields)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key")) for f in fields])
    keyed = df.select(F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("p"), *[F.col(a).cast("string").alias(f"a{i}") for i, a in enumerate(asset)], F.unix_micros(F.col(when).cast("timestamp")).alias("t"))
    ids = [f"a{i}" for i in range(len(asset))]
    once = keyed.groupBy("p.field", "p.key", *ids).agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))
    once = once.select("field", "key", "n", F.col(ids[-1]).isNotNull().cast("bigint").alias("a"), F.coalesce("t", F.lit(_LOWEST)).alias("t"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fan = _fan()
        for pdf in batches:
            f, k, sums = _reduce(pdf["field"].to_numpy(object), pdf["key"].to_numpy(object), pdf["n"].to_numpy(), pdf["a"].to_numpy(), pdf["t"].to_numpy())
            yield _blocks(f, k, sums, n_blocks, fan)

    return _summed(once.mapInPandas(split, _PARTIAL))


def hot_keys(df: DataFrame, fields: Sequence[str], percent: int = 4) -> DataFrame:
    """field, key_value of the keys that hold at least percent of all rows of df, rows with a null key among them."""
    return key_counts(df, fields).filter(F.col("sightings") * 100 >= percent * df.agg(F.count(F.lit(1))).scalar()).select("field", "key_value")
