"""Same or nearly the same texts across splits, through a full-text index of the evaluation side.

Two texts overlap if both have at least MIN_WORDS words and their longest common subsequence of words
covers SHARE of the longer text. Such a pair of n and m words leaves at most D = n + m - 2 * ceil(SHARE *
max(n, m)) words unmatched on either side, and each unmatched word breaks at most one of any set of
disjoint blocks of the streamed text. So of any D + 1 disjoint blocks one stands unbroken in the partner.
Backward search gives the occurrences of every short block; the D + 1 disjoint blocks with the fewest
occurrences in sum are looked up (exact: no candidate is lost, none is capped). Partners so found are
settled by an exact common-subsequence length, and backward search, carried on from each occurrence, gives
the maximal matches of a pair, which are merged into spans.

The index comes in shards. A text is only sent to the shards that hold a text with which it shares two of
its rarest words: with u = n - ceil(SHARE * n) words to spare, partners share all but u of either text's
distinct words, hence two among the first u + 2 in any common order of words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.fmindex import WordIndex
from voxloom.llm.text import digest, words
from voxloom.operators.joins import attach_unknown
from voxloom.storage import cut

MIN_WORDS = 6
SHARE = (4, 5)
SHARD_WORDS = 4_000_000
LANE_TEXTS = 400_000
MAX_BLOCK = 4
MATCH_WORDS = 3
WINDOW_WORDS = 64  # blocks are chosen window by window
HITS_AT_ONCE = 400_000
WORDS_AT_ONCE = 8_000_000
COMMON = (64, 2048)  # a word on at least such a fraction of all evaluation words is common, so late in order
PAIRED_WORDS = 40  # texts of more words are routed by single rare words, of which they have enough
PAIRS = "train_key binary, eval_key binary, train_words int, eval_words int, common int, spans int, span_words int"


def needed(longer: int | np.ndarray):
    """Common words needed if the longer text has this many words."""
    return -(-longer * SHARE[0] // SHARE[1])


@cache
def breaks(n: int) -> int:
    """Most words that a text of n words and any partner can leave unmatched, both sides together."""
    top = n * SHARE[1] // SHARE[0]
    return max(n + m - 2 * needed(max(n, m)) for m in {n, n - 1, top, top - 1, *range(max(MIN_WORDS, needed(n)), min(top, n + 40) + 1)}
               if m >= MIN_WORDS and needed(max(n, m)) <= min(n, m))


def common_words(masks: dict, n: int, other) -> int:
    """Longest common subsequence with the text whose positions per word are ``masks``, bit-parallel."""
    full = (1 << n) - 1
    s = full
    for w in other:
        u = s & masks.get(w, 0)
        s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def cheapest_blocks(cost: np.ndarray, blocks: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the disjoint blocks with the least cost in sum; ``cost[l - 1, text, start]``."""
    width, texts, n = cost.shape
    f = [np.zeros((texts, n + 1))]
    steps = []
    for _ in range(blocks):
        g = np.full((width, texts, n + 1), np.inf)
        for k in range(width):
            g[k, :, k + 1 :] = f[-1][:, : n - k] + cost[k, :, : n - k]
        steps.append(g)
        f.append(np.minimum.accumulate(g.min(0), axis=1))
    at, row, out = np.full(texts, n), np.arange(texts), []
    for k in range(blocks, 0, -1):
        best = f[k][row, at]
        at = np.argmax(f[k] == best[:, None], axis=1)
        length = np.argmin(steps[k - 1][:, row, at], axis=0) + 1
        at = at - length
        out.append((at, length))
    return out


class Searcher:
    """Streams texts through one index shard."""

    def __init__(self, blob: bytes):
        self.index = WordIndex.loads(blob)
        self.text = self.index.text()
        self.lens = np.diff(self.index.starts) - 1

    def blocks(self, sym: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        """(text, start, length, lo, hi) of the blocks to look up, over all texts of a batch."""
        ix, total = self.index, len(sym)
        room = np.arange(total) - np.repeat(starts, lens)  # words before this one in its text
        known = sym >= 0
        lo, hi = np.zeros(total, np.int64), np.where(known, ix.size, 0)
        los, his = np.zeros((MAX_BLOCK, total), np.int64), np.zeros((MAX_BLOCK, total), np.int64)
        live = np.flatnonzero(known)
        for d in range(MAX_BLOCK):  # state of each end position; stored under the block's start
            at = live - d
            a, b = ix.extend(sym[at], lo[live], hi[live])
            lo[live], hi[live] = a, b
            los[d, at], his[d, at] = a, b
            keep = (b > a) & (room[live] > d)
            live = live[keep]
            live = live[sym[live - d - 1] >= 0]
        counts = (his - los).astype(np.float64)
        out = []
        for n in np.unique(lens):
            rows, want = np.flatnonzero(lens == n), breaks(int(n)) + 1
            windows = -(-int(n) // WINDOW_WORDS)
            edge = np.arange(windows + 1) * int(n) // windows
            for w in range(windows):
                size = int(edge[w + 1] - edge[w])
                share = -(-want * size // int(n))  # in sum at least ``want``
                group = max(1, WORDS_AT_ONCE // (share * size * MAX_BLOCK))
                for g in range(0, len(rows), group):
                    mine = rows[g : g + group]
                    first = starts[mine] + edge[w]
                    cost = counts[:, first[:, None] + np.arange(size)]
                    for d in range(MAX_BLOCK):
                        cost[d, :, max(size - d, 0) :] = np.inf
                    for s, k in cheapest_blocks(cost, share):
                        at = first + s
                        out.append(np.stack([mine, edge[w] + s, k, los[k - 1, at], his[k - 1, at]]))
        return np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)

    def search(self, keys: list, texts: list[np.ndarray]):
        """Rows of PAIRS for a batch of word-hash sequences.

        Hits are followed up in bounded numbers, also within a text; of a text only the partners that
        share enough words are kept until all its hits are known.
        """
        lens = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
        sym = self.index.symbols(np.concatenate(texts))
        block = self.blocks(sym, starts, lens)
        block = block[:, block[4] > block[3]]
        block = block[:, np.argsort(block[0], kind="stable")]
        have = np.unique(np.repeat(np.arange(len(lens)), lens) * (len(self.index.vocab) + 2) + sym + 1)
        waiting = np.zeros(0, np.int64)
        for which, rows, last in self.hits(block[3], block[4], lens[block[0]]):
            waiting = np.union1d(waiting, self.promising(block[:3, which], rows, lens, have))
            done = len(waiting) if last else np.searchsorted(waiting, block[0, which[-1]] * len(self.lens))
            yield from self.settle(waiting[:done], keys, sym, starts, lens)
            waiting = waiting[done:]

    def hits(self, lo: np.ndarray, hi: np.ndarray, words: np.ndarray):
        """(which interval, row, whether these are the last) of all rows of the intervals [lo, hi), in bounded numbers.

        ``words`` is what a row of an interval costs at most.
        """
        ends = np.cumsum(hi - lo)
        dearest = np.maximum.accumulate(words[::-1])[::-1]
        total, first = int(ends[-1]) if len(ends) else 0, 0
        while first < total:
            head = int(np.searchsorted(ends, first, side="right"))
            last = min(total, first + max(1, min(HITS_AT_ONCE, WORDS_AT_ONCE // int(dearest[head]))))
            flat = np.arange(first, last)
            which = np.searchsorted(ends, flat, side="right")
            yield which, hi[which] - (ends[which] - flat), last == total
            first = last

    def promising(self, block: np.ndarray, rows: np.ndarray, lens: np.ndarray, have: np.ndarray) -> np.ndarray:
        """Distinct pairs (text * sequences + sequence) that the hits allow and that share enough words."""
        ix, vocab = self.index, len(self.index.vocab) + 2
        t, i, k = block
        pos = ix.locate(rows)
        doc = np.searchsorted(ix.starts, pos, side="right") - 1
        q, n, m = pos - ix.starts[doc], lens[t], self.lens[doc]
        ok = np.minimum(i, q) + k + np.minimum(n - i - k, m - q - k) >= needed(np.maximum(n, m))
        pair = np.unique(t[ok] * len(self.lens) + doc[ok])
        if not len(pair):
            return pair
        t, doc = pair // len(self.lens), pair % len(self.lens)
        size = self.lens[doc]
        flat = np.repeat(ix.starts[doc], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        probe = np.repeat(t, size) * vocab + self.text[flat] + 1
        at = np.minimum(np.searchsorted(have, probe), len(have) - 1)
        shared = np.add.reduceat((have[at] == probe).astype(np.int64), np.cumsum(size) - size)
        return pair[shared >= needed(np.maximum(lens[t], size))]

    def settle(self, pairs: np.ndarray, keys: list, sym: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        """Rows of PAIRS from all promising pairs of some texts."""
        ix, kept, was, masks = self.index, [], -1, {}
        for pair in pairs.tolist():
            t, doc = divmod(pair, len(self.lens))
            other = self.text[ix.starts[doc] : ix.starts[doc] + self.lens[doc]]
            if t != was:
                was, masks = t, {}
                for p, w in enumerate(sym[starts[t] : starts[t] + lens[t]].tolist()):
                    if w >= 0:
                        masks[w] = masks.get(w, 0) | 1 << p
            common = common_words(masks, int(lens[t]), other.tolist())
            if common >= needed(max(int(lens[t]), len(other))):
                kept.append((pair, common))
        spans = self.maximal(np.array([p for p, _ in kept], np.int64), sym, starts, lens) if kept else {}
        for pair, common in kept:
            t, doc = divmod(pair, len(self.lens))
            own = merged(spans.get(pair, ()))
            yield keys[t], ix.keys[doc], int(lens[t]), int(self.lens[doc]), common, len(own), sum(z - a for a, z in own)

    def maximal(self, pairs: np.ndarray, sym: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> dict[int, set]:
        """Per pair the maximal matches of at least MATCH_WORDS words, as (start, end) in the text.

        Every such match covers two words from an even place on, so those are looked up; backward search
        goes on from each occurrence in a partner as long as the words before agree, and to the right the
        restored text is compared.
        """
        ix, out = self.index, {}
        texts = np.unique(pairs // len(self.lens))
        n = lens[texts] // 2
        t = np.repeat(texts, n)
        i = 2 * (np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n))
        known = (sym[starts[t] + i] >= 0) & (sym[starts[t] + i + 1] >= 0)
        t, i = t[known], i[known]
        lo, hi = ix.extend(sym[starts[t] + i + 1], np.zeros(len(t), np.int64), np.full(len(t), ix.size))
        lo, hi = ix.extend(sym[starts[t] + i], lo, hi)
        for which, rows, _ in self.hits(lo, hi, np.ones(len(t), np.int64)):
            pos = ix.locate(rows)
            doc = np.searchsorted(ix.starts, pos, side="right") - 1
            pair = t[which] * len(self.lens) + doc
            mine = np.isin(pair, pairs)
            pair, left, right, rows, pos = pair[mine], i[which][mine], i[which][mine] + 2, rows[mine], pos[mine] + 2
            text = pair // len(self.lens)
            live = np.arange(len(pair))
            while len(live := live[left[live] > 0]):
                ok, new = ix.extend_rows(sym[starts[text[live]] + left[live] - 1], rows[live])
                live = live[ok]
                rows[live] = new
                left[live] -= 1
            live = np.arange(len(pair))
            while len(live := live[right[live] < lens[text[live]]]):  # a sequence ends in a 0, which no word equals
                live = live[sym[starts[text[live]] + right[live]] == self.text[pos[live]]]
                right[live] += 1
                pos[live] += 1
            for p, a, z in zip(pair.tolist(), left.tolist(), right.tolist()):
                if z - a >= MATCH_WORDS:
                    out.setdefault(p, set()).add((a, z))
        return out


def merged(spans) -> list[tuple[int, int]]:
    """Spans that touch or overlap merged, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def word_classes(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): ids by word sequence, and each distinct sequence once as word hashes.

    Texts that are null or have fewer than MIN_WORDS words are in neither. Copies collapse by partial
    aggregation, so a text that holds a third of all rows is searched once.
    """
    w = df.select(F.col(id_col).alias("id"), words(F.col(text)).alias("w")).where(F.size("w") >= MIN_WORDS)
    w = w.withColumn("key", digest(F.array_join("w", " ")))
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    return w.select("key", "id").distinct(), w.select("key", hashes.alias("w")).groupBy("key").agg(F.first("w").alias("w"))


def index_shards(classes: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, int]:
    """(classes with shard, (shard, blob), number of shards): a shard holds about ``shard_words`` words at most."""
    classes = cut(classes)
    total = classes.agg(F.sum(F.size("w"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))

    def build(key, pdf):
        ix = WordIndex.build([np.asarray(w, np.int64) for w in pdf["w"]], list(pdf["key"]))
        return pd.DataFrame({"shard": [key[0]], "blob": [ix.dumps()]})

    placed = classes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return placed, cut(placed.groupBy("shard").applyInPandas(build, "shard int, blob binary")), shards


def common_tiers(classes: DataFrame) -> list[list[int]]:
    """Per fraction 1/c of COMMON the words that make up at least that fraction of all words, at most c."""
    counts = classes.select(F.explode("w").alias("w")).groupBy("w").count()
    total = classes.agg(F.sum(F.size("w"))).first()[0] or 1
    frequent = counts.where(F.col("count") * max(COMMON) >= total).collect()
    return [[r["w"] for r in frequent if r["count"] * c >= total] for c in COMMON]


def routes(w: Column, tiers: list[list[int]], streamed: bool) -> Column:
    """Keys of a text of which partners share one: pairs of its rarest words.

    Words are ordered by tier, then hash. A text with too few different words, which might share but one
    with a partner, and one of more than PAIRED_WORDS words, give single words as well or instead; the
    indexed side gives both wherever a partner may give either.
    """
    def keys(s: Column) -> Column:
        n, rare = s["n"], s["rare"]
        spare = (n - F.floor((n * SHARE[0] + SHARE[1] - 1) / SHARE[1])).cast("int")
        pairs = bound(F.slice(rare, F.lit(1), spare + 2), lambda f: F.flatten(F.transform(f, lambda x, i: F.transform(
            F.slice(f, i + 2, F.greatest(F.size(f) - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y)))))
        singles = F.slice(rare, F.lit(1), spare + 1)
        upto = PAIRED_WORDS if streamed else PAIRED_WORDS * SHARE[1] // SHARE[0]
        above = PAIRED_WORDS if streamed else PAIRED_WORDS * SHARE[0] // SHARE[1] - 1
        some = F.when(n <= upto, pairs).otherwise(none)
        return F.concat(some, F.when((n > above) | (F.size(rare) < spare + 2), singles).otherwise(none))

    none = F.array().cast("array<long>")
    tier = lambda x: sum((x.isin(t).cast("long") for t in tiers if t), F.lit(0).cast("long"))
    order = lambda x: F.shiftleft(tier(x), 61) + F.shiftrightunsigned(x, 3)
    rare = F.sort_array(F.transform(F.array_distinct(w), order))
    return bound(F.struct(F.size(w).alias("n"), rare.alias("rare")), keys)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once per row."""
    return F.transform(F.array(c), use)[0]


def overlaps(train: DataFrame, evals: DataFrame, shard_words: int = SHARD_WORDS, lane_texts: int = LANE_TEXTS) -> DataFrame:
    """Pairs of distinct word sequences that overlap; columns PAIRS.

    ``train`` and ``evals`` are classes from ``word_classes``. The evaluation side becomes index shards
    of bounded size. Of the training side only keys of rare word pairs are shuffled; a text then goes to
    the shards that know one of its keys, in lanes of about ``lane_texts`` texts a shard, so the index is
    copied once per lane and texts that no shard can match are not moved. A lane's index row comes first
    in its partition and its texts stream past in batches: memory is one shard plus one batch whatever
    the sizes. If either side is empty there are no pairs.
    """
    spark = train.sparkSession
    placed, index, shards = index_shards(evals, shard_words)
    tiers = common_tiers(placed)
    train = train.withColumn("row", F.monotonically_increasing_id()).withColumn("routes", F.array_distinct(routes(F.col("w"), tiers, True)))
    train = cut(train)
    spots = placed.select("shard", F.explode(F.array_distinct(routes(F.col("w"), tiers, False))).alias("route"))
    spots = cut(spots.groupBy("route").agg(F.collect_set("shard").alias("shards")))
    asked = train.select("row", F.explode("routes").alias("route"))
    sent = attach_unknown(asked, spots, "route").select("row", F.explode("shards").alias("shard")).distinct()
    sent = cut(sent.groupBy("row").agg(F.collect_list("shard").alias("shards")))
    texts = cut(train.join(sent, "row").select("key", "w", "shards"))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    moves = texts.agg(F.sum(F.size("shards"))).first()[0] or 0
    lanes = max(-(-parallel // shards), -(-moves // (shards * lane_texts)))
    lane = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(lanes)).cast("int")
    texts = texts.select(F.explode("shards").alias("shard"), lane.alias("lane"), F.lit(1).alias("kind"), "key", "w", F.lit(None).cast("binary").alias("blob"))
    blobs = index.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"),
        F.lit(None).cast("binary").alias("key"), F.lit(None).cast("array<long>").alias("w"), "blob",
    )
    slots = texts.unionByName(blobs).withColumn("slot", F.col("shard") * lanes + F.col("lane"))
    slots = slots.repartitionById(shards * lanes, "slot").sortWithinPartitions("slot", "kind")

    def run(batches):
        searcher, slot = None, None
        for b in batches:
            for s, part in b.groupby("slot", sort=True):
                head = part[part["kind"] == 0]
                if len(head):
                    searcher, slot = Searcher(head["blob"].iloc[0]), s
                part = part[part["kind"] == 1]
                if len(part) and slot == s:
                    texts = [np.asarray(w, np.int64) for w in part["w"]]
                    yield pd.DataFrame(list(searcher.search(list(part["key"]), texts)), columns=NAMES)

    return slots.select("slot", "kind", "key", "w", "blob").mapInPandas(run, PAIRS)


NAMES = [c.split()[0] for c in PAIRS.split(", ")]
