"""Filling fixed-capacity containers: non-negative least squares over the length histogram."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.chunking import number_within_key
from voxloom.storage import cut

DEPTH = 3  # most different lengths in a combination
PARTNERS = 8  # middle lengths tried for each longest one
SLACK = 256  # a combination may leave 1/SLACK of the capacity free
LENGTH_BITS = 13  # lengths up to 2**13 are exact; longer ones are rounded up to so many leading bits


def rounded(n: Column) -> Column:
    """Lengths as the plan sees them: exact up to 8,192, beyond rounded up by at most a 4,096th."""
    extra = F.greatest(F.length(F.bin(n)) - LENGTH_BITS, F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), extra)
    return F.ceil(n / step) * step


def combinations(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, times): mixes of up to DEPTH of the given lengths that fill ``capacity`` but for a SLACKth.

    A mix is one, two, as many copies of a length as fit or half of that, then a second length, once or as often as it
    fits, then the longest that still fits. Second lengths are the longest that fits and PARTNERS evenly
    spaced shorter ones. Rows are padded with 0.
    """
    lengths = np.unique(lengths[(lengths > 0) & (lengths <= capacity)])
    if not len(lengths):
        return np.zeros((0, DEPTH), np.int64), np.zeros((0, DEPTH), np.int64)
    slack = capacity // SLACK
    most = capacity // lengths
    copies = np.unique(np.stack([np.tile(lengths, 4), np.concatenate([np.ones_like(most), np.minimum(most, 2), (most + 1) // 2, most])]), axis=1)
    a, ma = copies
    room = capacity - a * ma
    have = np.searchsorted(lengths, room, side="right")  # lengths that fit, shortest first
    zero = np.zeros(len(a), np.int64)
    out = [(np.stack([a, zero, zero]), np.stack([ma, zero, zero]))]
    for k in range(PARTNERS + 1):
        fits = np.flatnonzero(have > 0)
        at = (have[fits] - 1) * (PARTNERS - k) // PARTNERS
        b = lengths[at]
        for mb in (np.ones(len(b), np.int64), room[fits] // b):
            left = room[fits] - b * mb
            third = np.searchsorted(lengths, left, side="right")
            c = np.where(third > 0, lengths[np.maximum(third - 1, 0)], 0)
            mc = np.where(c > 0, left // np.maximum(c, 1), 0)
            out.append((np.stack([a[fits], b, c]), np.stack([ma[fits], mb, mc])))
    sizes, times = (np.concatenate([o[i] for o in out], axis=1).T for i in (0, 1))
    full = (sizes * times).sum(1) >= capacity - slack
    sizes, times = sizes[full], times[full]
    order = np.argsort(-sizes, axis=1, kind="stable")
    sizes, times = np.take_along_axis(sizes, order, 1), np.take_along_axis(times, order, 1)
    for i in range(DEPTH - 1):  # the same length twice counts as one
        same = (sizes[:, i] == sizes[:, i + 1]) & (sizes[:, i] > 0)
        times[same, i + 1] += times[same, i]
        times[same, i] = sizes[same, i] = 0
    order = np.argsort(-sizes, axis=1, kind="stable")
    both = np.concatenate([np.take_along_axis(sizes, order, 1), np.take_along_axis(times, order, 1)], axis=1)
    both = np.unique(both, axis=0)
    return both[:, :DEPTH], both[:, DEPTH:]


def nnls(sizes: np.ndarray, times: np.ndarray, histogram: np.ndarray, weight: np.ndarray, rounds: int = 600, tolerance: float = 1e-7) -> np.ndarray:
    """x >= 0 that nearly minimises |W (A x - h)|, where column j of A counts the lengths in combination j.

    W = diag(``weight``). Accelerated projected gradient with restarts over columns scaled to length 1; A is
    never formed, its products are one gather and one scatter. Entry 0 of ``histogram`` and ``weight``
    belongs to padding and is ignored.
    """
    if not len(sizes):
        return np.zeros(0)
    weight = np.concatenate(([0.0], weight[1:]))
    scale = (histogram * weight).max() or 1.0
    h, n = histogram * weight / scale, len(histogram)
    value = times * weight[sizes]
    norm = np.sqrt((value**2).sum(1))
    flat, entry = np.ascontiguousarray(sizes.T).ravel(), np.ascontiguousarray((value / norm[:, None]).T).ravel()

    def multiply(x):
        return np.bincount(flat, np.tile(x, DEPTH) * entry, n)

    def transposed(r):
        return (r[flat] * entry).reshape(DEPTH, -1).sum(0)

    v = np.ones(len(sizes))
    for _ in range(20):  # largest eigenvalue of the normal matrix gives the step
        v = transposed(multiply(v))
        size = np.linalg.norm(v)
        v /= size or 1.0
    step = 1.0 / (size * 1.02)
    x = y = np.zeros(len(sizes))
    t = 1.0
    for _ in range(rounds):
        miss = multiply(y) - h
        if miss @ miss < tolerance * (h @ h):
            break
        new = np.maximum(y - step * transposed(miss), 0.0)
        if (y - new) @ (new - x) > 0:
            t = 1.0
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / nt * (new - x)
        x, t = new, nt
    return x * scale / norm


def greedily(left: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Pack all of ``left`` (length -> items): each container takes the longest, then what still fits, longest first.

    As many equal containers are made as the counts allow, so the number of steps follows the lengths,
    not the items.
    """
    left, out = dict(left), []
    live = [s for s in sorted(left) if left[s]]
    while live:
        mix, room = Counter(), capacity
        while room and (at := bisect_right(live, room)):
            while at and left[live[at - 1]] <= mix[live[at - 1]]:
                at -= 1
            if not at:
                break
            size = live[at - 1]
            take = min(room // size, left[size] - mix[size])
            mix[size] += take
            room -= take * size
        mix = +mix
        n = min(left[s] // m for s, m in mix.items())
        for s, m in mix.items():
            left[s] -= n * m
            if not left[s]:
                live.remove(s)
        out.append((mix, n))
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(length -> items, containers) for lengths in 1..capacity: how many containers get which mix.

    The repeat counts are rounded along the combinations, so that the sum over any stretch of them is
    kept to within one, and used as far as items last; residuals are packed greedily. Every item is
    placed. Should the residuals of a poorly solvable histogram need more containers than everything
    packed greedily, the latter is taken.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([0, *(histogram[int(n)] for n in lengths)], float)
    sizes, times = combinations(lengths, capacity)
    index = np.where(sizes > 0, np.searchsorted(lengths, sizes) + 1, 0)
    x = nnls(index, times, counts, np.sqrt(np.append(0, lengths)))  # long items are hardest to place later
    left, out = dict(histogram), []
    wanted = np.diff(np.floor(np.cumsum(x) + 0.5).astype(np.int64), prepend=0)
    for j in np.flatnonzero(wanted):
        mix = {int(s): int(m) for s, m in zip(sizes[j], times[j]) if s}
        n = min(int(wanted[j]), *(left[s] // m for s, m in mix.items()))
        if n > 0:
            for s, m in mix.items():
                left[s] -= n * m
            out.append((Counter(mix), n))
    return min(out + greedily(left, capacity), greedily(histogram, capacity), key=lambda p: sum(n for _, n in p))


class Slots:
    """Where the k-th item of a length goes: sorted ranges of k, each over some equal containers."""

    def __init__(self, plans: list[list[tuple[Counter, int]]]):
        rows = []
        for c, p in enumerate(plans):
            base, used = 0, Counter()
            for mix, n in p:
                for size, m in mix.items():
                    rows.append((c, size, used[size], base, n))
                    used[size] += m * n
                base += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        groups, first = np.unique(table[:, :2], axis=0, return_index=True)
        self.group = {(c, s): i for i, (c, s) in enumerate(groups.tolist())}
        self.ends = np.append(first[1:], len(table))
        self.first, self.low, self.base, self.times = first, table[:, 2], table[:, 3], table[:, 4]

    def containers(self, container: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(rank), np.int64)
        order = np.lexsort((rank, size, container))
        c, s, r = container[order], size[order], rank[order]
        heads = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])))) if len(c) else []
        for a, z in zip(heads, [*heads[1:], len(c)]):
            g = self.group[int(c[a]), int(s[a])]
            low = self.low[self.first[g] : self.ends[g]]
            at = self.first[g] + np.searchsorted(low, r[a:z], side="right") - 1
            out[order[a:z]] = self.base[at] + (r[a:z] - self.low[at]) % self.times[at]
        return out


def pack(docs: DataFrame, doc_id: str, tokens: str, capacities: dict[str, int]) -> DataFrame:
    """(container, container_no, doc_id, piece, start_token, tokens): every item in a container, per capacity.

    An item longer than the capacity is cut into full pieces, each a container of its own, and a rest
    that is packed with the others; no other item is split. Items without tokens (null, 0) are left
    out. Per capacity the driver gets a histogram of at most 8,192 lengths and 4,096 more for every
    doubling beyond, and the plan is broadcast: at most one range for each combination and length in it.
    Items of one length are told apart by their exact number within the length, so a length that most
    items share stays spread out, and find their range by binary search.
    """
    spark = docs.sparkSession
    names = list(capacities)
    items = cut(docs.where(F.col(tokens) > 0).select(F.col(doc_id).alias("doc_id"), F.col(tokens).alias("n")))
    caps = spark.createDataFrame([(i, k, int(capacities[k])) for i, k in enumerate(names)], "c int, container string, capacity long")
    each = items.crossJoin(F.broadcast(caps)).withColumn("full", F.floor(F.col("n") / F.col("capacity")).cast("long"))
    full = each.where("full > 0").select(
        "container", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"), "capacity"
    ).select(
        "container", F.concat_ws("_", F.lit("f"), "doc_id", "piece").alias("container_no"), "doc_id", "piece",
        (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("tokens"),
    )
    rest = each.withColumn("n_", F.col("n") - F.col("full") * F.col("capacity")).where("n_ > 0").select(
        "c", "container", F.least(rounded(F.col("n_")), "capacity").alias("size"), "doc_id",
        F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).alias("start_token"), F.col("n_").alias("tokens"),
    )
    counts: list[dict[int, int]] = [{} for _ in names]
    for r in rest.groupBy("c", "size").count().toLocalIterator():
        counts[r["c"]][r["size"]] = r["count"]
    slots = spark.sparkContext.broadcast(Slots([plan(h, int(capacities[k])) for h, k in zip(counts, names)]))

    @F.pandas_udf("long")
    def container(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for c, size, rank in parts:
            yield pd.Series(slots.value.containers(c.to_numpy(), size.to_numpy(), rank.to_numpy()))

    order = ["c", "size", "h", "doc_id"]  # a length's items stand together, so few offsets are needed, yet split anywhere
    numbered = number_within_key(rest.withColumn("h", F.xxhash64("doc_id", "container")), ["c", "size"], order)
    placed = numbered.select(
        "container", F.concat(F.lit("p"), container("c", "size", "rank_in_key")).alias("container_no"), "doc_id", "piece", "start_token", "tokens"
    )
    return full.unionByName(placed)


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(container, capacity, containers, items, tokens, fill) of a packing."""
    per = packed.groupBy("container", "container_no").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    caps = packed.sparkSession.createDataFrame([(k, int(v)) for k, v in capacities.items()], "container string, capacity long")
    out = per.groupBy("container").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    return out.join(F.broadcast(caps), "container").select(
        "container", "capacity", "containers", "items", "tokens",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"),
    )
