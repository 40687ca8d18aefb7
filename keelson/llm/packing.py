"""Filling containers of fixed capacity with texts measured in tokens.

Everything is decided on the global histogram of lengths, which has at most as many entries as a container has tokens, however many
texts there are. bucket_bounds finds the length buckets of least padding by dynamic programming, batches forms token-budget batches
inside each bucket. Batches of padded items leave more space unused than need be, so containers are filled from a plan instead: with a
bucket for each single length the padding is nothing, and a container takes from several buckets what fills it best. The plan says how
often each pattern of lengths is filled; the texts find their place by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.tokens import FOLDER, encoded
from keelson.session import materialised

#: Parts that the items of one length are ranked in, so that a length which many texts share is spread over tasks.
PARTS = 256


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most so many buckets for which padding every item to its bucket's bound adds least.

    lengths ascend without repeats. Dynamic programming with divide and conquer, as the best last cut moves only upwards.
    """
    n = len(lengths)
    if n == 0:
        return []
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    mass = np.concatenate([[0], np.cumsum(counts * lengths.astype(np.float64))])
    cost = np.array([lengths[j - 1] * total[j] - mass[j] if j else 0.0 for j in range(n + 1)])
    cuts = [np.zeros(n + 1, int)]
    for _ in range(min(buckets, n) - 1):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        new[0] = 0.0
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            value = cost[i] + lengths[mid - 1] * (total[mid] - total[i]) - (mass[mid] - mass[i])
            k = int(np.argmin(value))
            new[mid], arg[mid] = value[k], i[k]
            stack += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        cost = new
        cuts.append(arg)
    bounds, j = [], n
    for arg in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(arg[j])
    return bounds[::-1]


def _best_fill(left: dict[int, int], sizes: np.ndarray, room: int) -> list[int]:
    """Lengths that fill room as well as can be found: the best of some greedy fills, each completed by the best pair."""

    def under(limit: int) -> int:
        at = int(np.searchsorted(sizes, limit, side="right"))
        return at

    best: list[int] = []
    best_sum = -1
    top = under(room)
    for first in range(top - 1, max(-1, top - 9), -1):
        used: dict[int, int] = {}
        picked, free = [], room
        at = first
        while at >= 0 and free > 0:
            s = int(sizes[at])
            if s <= free and left[s] > used.get(s, 0):
                rest = free - s
                if 0 < rest < s:  # the last two as a pair, if that fills better than the largest alone
                    picked.append(s)
                    used[s] = used.get(s, 0) + 1
                    free = rest
                    at = under(free) - 1
                    continue
                picked.append(s)
                used[s] = used.get(s, 0) + 1
                free = rest
                at = min(at, under(free) - 1)
            else:
                at = min(at - 1, under(free) - 1)
        if room - free > best_sum:
            best, best_sum = picked, room - free
            if free == 0:
                break
    return best


def fill_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to how many) with how often each is filled: all items of histogram, lengths from 1 to capacity, are placed.

    The longest item left opens a container, what fills it best follows; the pattern is repeated as often as the items last, so
    that there are about as many patterns as lengths, whatever the number of items.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    sizes = np.array(sorted(left))
    plan = []
    while left:
        top = int(sizes[-1])
        left[top] -= 1
        pattern = {top: 1}
        for s in _best_fill(left, sizes, capacity - top) if capacity > top else []:
            pattern[s] = pattern.get(s, 0) + 1
        left[top] += 1
        times = min(left[s] // c for s, c in pattern.items())
        plan.append((pattern, times))
        gone = False
        for s, c in pattern.items():
            left[s] -= c * times
            if not left[s]:
                del left[s]
                gone = True
        if gone:
            sizes = sizes[np.isin(sizes, np.fromiter(left, int, len(left)))]
    return plan


def items(sizes: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """container_kind, doc_id, part_no, start_token, length: a text as one item, or as full pieces and a rest if it exceeds the capacity."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("int").alias("capacity")) for k, c in kinds])).alias("c")
    pieces = sizes.select("doc_id", "n", each).select("doc_id", "n", "c.kind", "c.capacity", F.explode(F.expr("sequence(0, CASE WHEN n = 0 THEN 0 ELSE (n - 1) DIV c.capacity END)")).alias("part"))
    start = F.col("part") * F.col("capacity")
    return pieces.select(F.col("kind").alias("container_kind"), "doc_id", F.col("part").cast("int").alias("part_no"), start.cast("int").alias("start_token"), F.least("capacity", F.col("n") - start).cast("int").alias("length"))


def token_sizes(documents: DataFrame, tokenizer: str, folder: str = FOLDER) -> DataFrame:
    return encoded(documents, name=tokenizer, folder=folder).select("doc_id", F.size("ids").alias("n"))


def _kinds(capacities: DataFrame, most: int = 1000) -> dict[str, list[tuple[str, int]]]:
    """tokenizer to its (container_kind, capacity). The kinds are an enumeration; more than most of them is an error."""
    rows = capacities.filter("container_kind IS NOT NULL AND capacity > 0").select("tokenizer", "container_kind", "capacity").distinct().orderBy("container_kind").limit(most + 1).collect()
    if len(rows) > most or len({r["container_kind"] for r in rows}) < len(rows):
        raise ValueError("container kinds must be few and named once")
    out: dict[str, list[tuple[str, int]]] = {}
    for r in rows:
        out.setdefault(r["tokenizer"], []).append((r["container_kind"], int(r["capacity"])))
    return out


def _histograms(parts: DataFrame) -> dict[str, dict[int, int]]:
    """kind to length to count; at most as many lengths as the capacity."""
    out: dict[str, dict[int, int]] = {}
    for r in parts.groupBy("container_kind", "length").count().collect():
        out.setdefault(r["container_kind"], {})[r["length"]] = r["count"]
    return out


def containers(documents: DataFrame, capacities: DataFrame, folder: str = FOLDER) -> DataFrame:
    """container_kind, container_id, doc_id, part_no, start_token, end_token: every text in a container of every kind.

    Containers of a kind are numbered from 0 without gaps. A text of no tokens, also a null one, takes no space and stands in any
    container (in 0 if there is none else). Only a text longer than the capacity has more than one part: full ones and a rest.
    """
    out = None
    for tokenizer, kinds in _kinds(capacities).items():
        parts = items(materialised(token_sizes(documents, tokenizer, folder)), kinds)
        filled = place(parts, {k: fill_plan({s: c for s, c in h.items() if s > 0}, dict(kinds)[k]) for k, h in _histograms(parts).items()})
        out = filled if out is None else out.unionByName(filled)
    if out is None:
        raise ValueError("there is no container kind")
    return out


def ranked(parts: DataFrame, along: DataFrame | None = None) -> DataFrame:
    """parts with rank, from 0 among the items of a kind and length. along has further columns for each container_kind and length."""
    by = ["container_kind", "length", "h"]
    spread = parts.withColumn("h", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(PARTS)))
    counts = spread.groupBy(*by).count()
    offsets = counts.withColumn("offset", F.sum("count").over(Window.partitionBy("container_kind", "length").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    if along is not None:
        offsets = offsets.join(along, ["container_kind", "length"])
    own = spread.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "part_no")) - 1).join(offsets, by)
    more = [c for c in along.columns if c not in by] if along is not None else []
    return own.select("container_kind", "doc_id", "part_no", "start_token", "length", (F.col("r") + F.coalesce("offset", F.lit(0))).alias("rank"), *more)


def place(parts: DataFrame, plans: dict[str, list[tuple[dict[int, int], int]]]) -> DataFrame:
    """The items of parts in the containers that plans have for their lengths."""
    tables: dict[str, dict[int, tuple]] = {}
    totals: dict[str, int] = {}
    for kind, plan in plans.items():
        slots: dict[int, list[list[int]]] = {}
        base = 0
        for pattern, times in plan:
            for s, c in pattern.items():
                own = slots.setdefault(s, [[0], [], []])
                own[0].append(own[0][-1] + c * times)
                own[1].append(c)
                own[2].append(base)
            base += times
        totals[kind] = base
        tables[kind] = {s: tuple(np.array(x, np.int64) for x in own) for s, own in slots.items()}
    placed = ranked(parts)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = np.zeros(len(pdf), np.int64)
            rank = pdf["rank"].to_numpy(np.int64)
            for (kind, length), at in pdf.groupby(["container_kind", "length"]).indices.items():
                if length == 0:
                    ids[at] = rank[at] % max(1, totals[kind])
                    continue
                begins, each, base = tables[kind][int(length)]
                j = np.searchsorted(begins, rank[at], side="right") - 1
                ids[at] = base[j] + (rank[at] - begins[j]) // each[j]
            yield pd.DataFrame({"container_kind": pdf["container_kind"], "container_id": ids, "doc_id": pdf["doc_id"], "part_no": pdf["part_no"], "start_token": pdf["start_token"], "end_token": pdf["start_token"] + pdf["length"]})

    return placed.mapInPandas(assign, "container_kind string, container_id bigint, doc_id bigint, part_no int, start_token int, end_token int")


def batched(documents: DataFrame, capacities: DataFrame, buckets: int = 16, folder: str = FOLDER) -> DataFrame:
    """container_kind, bucket_no, bound, batch_no, doc_id, part_no, start_token, end_token: token-budget batches inside optimal length buckets.

    A batch holds as many items of its bucket, padded to the bucket's bound, as the capacity takes, by length; batches of a bucket are
    numbered from 0 without gaps, and only the last one isn't full. Empty texts are in no batch.
    """
    out = None
    for tokenizer, kinds in _kinds(capacities).items():
        parts = items(materialised(token_sizes(documents, tokenizer, folder)), kinds).filter("length > 0")
        rows = []
        for kind, h in _histograms(parts).items():
            lengths = np.array(sorted(h))
            bounds = bucket_bounds(lengths, np.array([h[s] for s in lengths.tolist()]), buckets)
            last, before = -1, 0
            for s in lengths.tolist():
                i = int(np.searchsorted(bounds, s))
                last, before = i, before if i == last else 0
                rows.append((kind, s, i, bounds[i], dict(kinds)[kind] // bounds[i], before))
                before += h[s]
        table = documents.sparkSession.createDataFrame(rows, "container_kind string, length int, bucket_no int, bound int, fit int, before bigint")
        got = ranked(parts, table).select("container_kind", "bucket_no", "bound", F.expr("(before + rank) DIV fit").alias("batch_no"), "doc_id", "part_no", "start_token", (F.col("start_token") + F.col("length")).alias("end_token"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("there is no container kind")
    return out


def batches(documents: DataFrame, capacities: DataFrame, buckets: int = 16, folder: str = FOLDER) -> DataFrame:
    """container_kind, bucket_no, bound, items, batches, tokens, padding: what batched formed, by bucket."""
    length = F.col("end_token") - F.col("start_token")
    by = ["container_kind", "bucket_no", "bound"]
    each = batched(documents, capacities, buckets, folder).groupBy(*by, "batch_no").agg(F.count(F.lit(1)).alias("items"), F.sum(length).alias("tokens"), F.sum(F.col("bound") - length).alias("padding"))
    return each.groupBy(*by).agg(F.sum("items").alias("items"), F.count(F.lit(1)).alias("batches"), F.sum("tokens").alias("tokens"), F.sum("padding").alias("padding"))
