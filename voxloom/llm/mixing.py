"""Mixing sources to target shares of the total size, by subset sums over exact lengths."""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.chunking import number_within_key
from voxloom.storage import cut

SEED = 20


def _chance(seed: int, source: str, length: int) -> int:
    """A seeded 64-bit number of a length of a source."""
    return int.from_bytes(blake2b(f"{seed} {source} {length}".encode(), digest_size=8).digest(), "big")


def subset_counts(counts: dict[int, int], budget: int, seed: int = SEED, source: str = "") -> dict[int, int]:
    """How many items of each length to take so that their lengths add up to ``budget``, or as near below as found.

    The histogram, scaled down to the budget less the longest length, is rounded along its lengths from a
    seeded start, so the taken lengths follow the source at every scale and the sum misses by less than
    the longest length. What is open then, at most twice that, is a bounded knapsack, solved exactly by
    reachable sums kept as bits, over the lengths in a seeded order (counts split into powers of two).
    """
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    goal = max(budget - max(counts), 0)
    take, seen, taken = {}, 0, 0
    start = _chance(seed, source, 0) % total
    for n in sorted(counts):
        seen += counts[n]
        upto = (seen * goal + start) // total
        take[n] = min(upto - taken, counts[n])
        taken = upto
    left = budget - sum(n * c for n, c in take.items())
    reach, mask, steps = 1, (1 << (left + 1)) - 1, []
    for n in sorted(counts, key=lambda n: _chance(seed, source, n)):
        free, k = min(counts[n] - take[n], left // n), 1
        while free > 0 and not reach >> left & 1:
            k = min(k, free)
            steps.append((n, k, reach))
            reach = (reach | reach << n * k) & mask
            free -= k
            k *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            take[n] += k
            at -= n * k
    return {n: c for n, c in take.items() if c}


def budgets(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens each source should give. Sources without tokens give 0 and the others' shares are scaled up.

    ``total`` defaults to the largest for which no source needs more than its cap of repeats; a larger
    one is met as far as the caps allow.
    """
    have = {s: (w, r) for s, (w, r) in targets.items() if sizes.get(s, 0) > 0 and w > 0 and r > 0}
    norm = sum(w for w, _ in have.values())
    if total is None:
        total = min((int(sizes[s] * r * norm / w) for s, (w, r) in have.items()), default=0)
    return {s: min(round(total * w / norm), sizes[s] * r) for s, (w, r) in have.items()}


def mix(
    docs: DataFrame, doc_id: str, source: str, tokens: str, targets: dict[str, tuple[float, int]],
    total: int | None = None, seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each text is used, texts not used left out.

    ``targets`` maps a source to (share of the total, most repeats). A source is used whole as often as
    its budget allows; the remaining budget is met by ``subset_counts`` over its lengths, which the texts
    taken follow, and which texts of a length get the extra copy is decided by a seeded hash. Texts without tokens and of sources
    without a target are left out. The driver sees the number of texts per (source, length): lengths
    add up to the tokens T of a source, so there are at most sqrt(2T) of them.
    """
    spark = docs.sparkSession
    wanted = F.col(source).isin(list(targets))
    items = cut(docs.where(wanted & (F.col(tokens) > 0)).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(tokens).alias("tokens")))
    counts: dict[str, dict[int, int]] = {}
    for r in items.groupBy("source", "tokens").count().toLocalIterator():
        counts.setdefault(r["source"], {})[r["tokens"]] = r["count"]
    sizes = {s: sum(n * c for n, c in h.items()) for s, h in counts.items()}
    whole, extra = [], []
    for s, b in budgets(sizes, targets, total).items():
        times, rest = divmod(b, sizes[s])
        whole.append((s, times))
        extra += [(s, n, c) for n, c in subset_counts(counts[s], rest, seed, s).items()]
    w = spark.createDataFrame(whole or [("", 0)], "source string, whole long")
    e = spark.createDataFrame(extra or [("", 0, 0)], "source string, tokens long, extra long")
    order = ["source", "tokens", "h", "doc_id"]  # a key's rows stand together, so few offsets are needed, yet split anywhere
    numbered = number_within_key(items.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), ["source", "tokens"], order)
    copies = F.coalesce("whole", F.lit(0)) + (F.col("rank_in_key") < F.coalesce("extra", F.lit(0))).cast("long")
    out = numbered.join(F.broadcast(w), "source", "left").join(e, ["source", "tokens"], "left")
    return out.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def share_report(mixed: DataFrame, items: DataFrame, source: str, tokens: str, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, used_tokens, texts_used, most_copies, reached_share)."""
    t = mixed.sparkSession.createDataFrame([(s, float(w), int(r)) for s, (w, r) in targets.items()], "source string, target_share double, max_repeats int")
    available = items.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("available_tokens"))
    used = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("texts_used"), F.max("copies").alias("most_copies")
    )
    total = used.agg(F.sum("used_tokens").alias("all"))
    zero = F.lit(0).cast("long")
    return t.join(available, "source", "left").join(used, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("available_tokens", "used_tokens", "texts_used", "most_copies")],
        F.round(F.coalesce("used_tokens", zero) / F.col("all"), 6).alias("reached_share"),
    )
