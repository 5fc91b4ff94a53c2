"""Splits that keep related records together, balanced by largest differencing."""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.components import components
from voxloom.operators.chunking import number_within_key
from voxloom.operators.joins import attach_by_key
from voxloom.storage import cut, once

BINS, MIN_BINS = 100, 5
SEED = 20


def relation_tokens(clip_id: Column, speaker: Column, book: Column) -> Column:
    """What relates a clip to others: 's:' + each speaker named, 'b:' + book, 'r:' + recording.

    Null, blank and 'unknown' relate nothing, and an id without '__seg_' gives no recording.
    """
    named = F.transform(F.split(F.coalesce(speaker, F.lit("")), ","), lambda s: F.trim(s))
    named = F.filter(named, lambda s: (s != "") & (s != "unknown"))
    known = F.when((F.trim(book) != "") & (F.trim(book) != "unknown"), book)
    recording = F.when(F.locate("__seg_", clip_id) > 1, F.substring_index(clip_id, "__seg_", 1))
    return F.array_distinct(F.concat(
        F.transform(named, lambda s: F.concat(F.lit("s:"), s)),
        F.array_compact(F.array(F.concat(F.lit("b:"), known), F.concat(F.lit("r:"), recording))),
    ))


def related_groups(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(combos, roots) of clips(id, tokens).

    combos: tokens and n, one row per distinct token list; roots: node, root over all tokens. Clips
    collapse to distinct token lists before any link is made, and a list links its tokens as a star.
    """
    combos = cut(clips.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count("*").alias("n")))
    links = combos.select(F.col("tokens")[0].alias("a"), F.explode("tokens").alias("b")).distinct()
    return combos, cut(components(links, "a", "b"))


def bins_for(targets: dict[str, float]) -> int:
    """Bins fine enough that the smallest share is worth MIN_BINS of them, and at least BINS."""
    shares = [v for v in targets.values() if v > 0]
    return max([BINS, *(ceil(MIN_BINS * sum(shares) / v) for v in shares)])


class Differencing:
    """Components spread over ``bins`` bins of nearly equal total by largest differencing.

    ``weights`` maps a weight to the number of components that have it. Whole rounds of equal components
    fill every bin alike. What remains of a weight, fewer than ``bins``, is one tuple of bin totals, and
    the two tuples with the largest spread are combined, largest bins against smallest, until one is
    left. So there are as many steps as weights, each on arrays of ``bins`` totals.
    """

    def __init__(self, weights: dict[int, int], bins: int):
        self.base = {w: c // bins for w, c in weights.items() if c >= bins}
        level = sum(w * c for w, c in self.base.items())
        self.rest = [(w, c % bins) for w, c in sorted(weights.items(), reverse=True) if c % bins]
        tuples, heap = [], []
        for i, (w, c) in enumerate(self.rest):
            tuples.append(np.concatenate([np.full(c, w, np.int64), np.zeros(bins - c, np.int64)]))
            heapq.heappush(heap, (-w, i))
        kind = np.uint16 if bins < 1 << 16 else np.uint32
        self.steps = []
        while len(heap) > 1:
            (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
            total = tuples[x] + tuples[y][::-1]
            order = np.argsort(-total, kind="stable")
            tuples[x] = tuples[y] = None
            self.steps.append((x, y, order.astype(kind)))
            tuples.append(total[order])
            heapq.heappush(heap, (int(tuples[-1][-1] - tuples[-1][0]), len(tuples) - 1))
        self.bins = bins
        self.totals = level + (tuples[heap[0][1]] if heap else np.zeros(bins, np.int64))
        self.last = heap[0][1] if heap else -1

    def counts(self, split_of_bin: np.ndarray, splits: int) -> dict[int, np.ndarray]:
        """Per weight the components of it in each split, by walking the steps back."""
        per = np.bincount(split_of_bin, minlength=splits)
        out = {w: c * per for w, c in self.base.items()}
        at = {self.last: np.arange(self.bins)} if self.last >= 0 else {}
        for node in range(self.last, len(self.rest) - 1, -1):
            x, y, order = self.steps[node - len(self.rest)]
            place = order[at.pop(node)].astype(np.int64)
            at[x], at[y] = place, self.bins - 1 - place
        for i, place in at.items():
            w, c = self.rest[i]
            out[w] = out.get(w, 0) + np.bincount(split_of_bin[place < c], minlength=splits)
        return out


def fill_splits(totals: np.ndarray, shares: dict[str, float]) -> tuple[list[str], np.ndarray]:
    """(splits, split number of each bin): whole bins, largest first, go to the split furthest below its share."""
    total, norm = float(totals.sum()) or 1.0, sum(shares.values()) or 1.0
    names = sorted(shares)
    lack = [shares[s] / norm * total for s in names]
    out = np.zeros(len(totals), np.int64)
    for b in np.argsort(-totals, kind="stable"):
        s = max(range(len(names)), key=lack.__getitem__)
        lack[s] -= int(totals[b])
        out[b] = s
    return names, out


def place_groups(clips: DataFrame, targets: dict[str, float], bins: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(combos, roots, placed) of clips(id, tokens); placed: root, split, one row per group.

    Clips without tokens are groups of one, with root 'i:' + id. Only the histogram of group sizes
    reaches the driver; the sizes add up to the number of clips N, so it has at most sqrt(2N) entries.
    Groups of equal size are told apart by a seeded hash, and numbered exactly even if one size holds
    most groups. Shares are scaled to add up to 1.
    """
    combos, roots = related_groups(clips)
    usage = combos.groupBy(F.col("tokens")[0].alias("node")).agg(F.sum("n").alias("n"))
    sizes = usage.join(roots, "node").groupBy("root").agg(F.sum("n").alias("weight"))
    alone = clips.where(F.size("tokens") == 0).select(F.concat(F.lit("i:"), "id").alias("root"), F.lit(1).cast("long").alias("weight"))
    sizes = cut(sizes.unionByName(alone))
    histogram = {r["weight"]: r["count"] for r in sizes.groupBy("weight").count().toLocalIterator()}
    spread = Differencing(histogram, bins or bins_for(targets))
    names, split_of_bin = fill_splits(spread.totals, targets)
    rows = [(w, histogram[w], np.cumsum(c).tolist()) for w, c in spread.counts(split_of_bin, len(names)).items()]
    table = clips.sparkSession.createDataFrame(rows, "weight long, groups long, upto array<long>")
    order = ["weight", "h", "root"]
    numbered = number_within_key(sizes.withColumn("h", F.xxhash64("root", F.lit(seed))), ["weight"], order)
    split = F.array(*map(F.lit, names))[F.size(F.filter("upto", lambda u: u <= F.col("rank_in_key")))]
    return combos, roots, cut(attach_by_key(numbered, table, "weight", "groups").select("root", split.alias("split")))


def assign(clips: DataFrame, targets: dict[str, float], bins: int | None = None, seed: int = SEED) -> DataFrame:
    """(id, split) for clips(id, tokens): clips that share a token, directly or through others, share a split.

    Empty input gives no rows.
    """
    clips = cut(clips)
    combos, roots, placed = place_groups(clips, targets, bins, seed)
    head = F.col("tokens")[0]
    usage = combos.groupBy(head.alias("node")).agg(F.sum("n").alias("n"))
    by_token = cut(usage.join(roots, "node").join(placed, "root").select("node", "n", "split"))
    keyed = clips.where(F.size("tokens") > 0).select("id", head.alias("node"))
    lone = placed.where(F.col("root").startswith("i:")).select(F.expr("substring(root, 3)").alias("id"), "split")
    return attach_by_key(keyed, by_token, "node", "n").select("id", "split").unionByName(lone)


def speakers_together(clips: DataFrame, targets: dict[str, float], bins: int | None = None, seed: int = SEED) -> DataFrame:
    """(speaker_a, speaker_b, split): each speaker of a placed group except its smallest, which is speaker_a."""
    _, roots, placed = place_groups(cut(clips), targets, bins, seed)
    named = cut(roots.where(F.col("node").startswith("s:")).select("root", F.expr("substring(node, 3)").alias("speaker_b")))
    first = named.groupBy("root").agg(F.min("speaker_b").alias("speaker_a"), F.count("*").alias("n"))
    out = attach_by_key(named, cut(first.join(placed, "root")), "root", "n").where(F.col("speaker_a") != F.col("speaker_b"))
    return out.select("speaker_a", "speaker_b", "split")


def clips_with_tokens(manifest: DataFrame) -> DataFrame:
    """Distinct clips with their tokens. An id delivered with differing relations keeps all of them."""
    c = once(manifest, "ingested_at", "id", "speaker_id", "book_title")
    tokens = relation_tokens(F.col("id"), F.col("speaker_id"), F.col("book_title"))
    return c.where(F.col("id").isNotNull()).select("id", tokens.alias("tokens"))
