"""Best-fit packing of documents into sequences by bin completion.

Only the histogram of piece lengths (at most ``capacity`` numbers) decides how
many sequences are needed, so the search runs on the driver over the histogram
while pieces stay distributed.  Best fit gives the first incumbent.  Then, around
the longest remaining length, the search enumerates fillings that no other filling
dominates, by the sums that the remaining lengths can reach, takes the best first,
applies each as often as the counts allow, and gives up a branch when its waste
exceeds what the incumbent permits.  It ends at the lower bound or after a number
of nodes; above the bound, items are then exchanged among the loosest sequences,
which is an extra to the search and can be left out.

The search is bounded, so the plan is valid but not proven least unless it meets
the lower bound: four fillings of each room are branches, among the first 300
found; 400 open branches are kept; whether a filling of more than ten items is
dominated isn't tested (which keeps a needless branch at most).

The plan says which ranks of each length go to which sequence; a piece's rank is
its place among all pieces of its length, from per-task counters and a running
sum of per-task counts.  No group of equal lengths meets in one task.

Null or empty text: the end id alone.  Texts longer than the capacity are cut
into pieces of exactly ``capacity`` ids, but for the first, which takes the
rest.  Repeated rows are separate documents; null and repeated keys are kept as
they are and decide nothing.  Other columns are ignored.  An empty table packs to
no rows.
"""

from __future__ import annotations

import base64
import collections
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop, stage, vocabulary

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


#: Texts of so many characters go to the library at once: the splitter of the
#: rank table takes time in proportion to the square of some long runs.
LONG = 200_000


class Ids:
    """Ids of the ``tokenizers`` file, through the rank table of the same
    vocabulary, which is several times faster and gives the same ids; long texts,
    and those that its splitter refuses (such as endless blanks), go to the
    library itself.  Tests hold both equal on random strings and at the bound."""

    def __init__(self, path: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if len(text) < LONG:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # how its splitter gives up: no subclass of Exception
                    raise
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def ids_of(path: str, ranks: str) -> Ids:
    return Ids(path, ranks)


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes the rest."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def _fit(items: list[int], rooms: list[int]) -> bool:
    """Whether the items, longest first, fit into the rooms."""
    if not items:
        return True
    tried = set()
    for i, r in enumerate(rooms):
        if r >= items[0] and r not in tried:
            tried.add(r)
            if _fit(items[1:], [*rooms[:i], r - items[0], *rooms[i + 1 :]]):
                return True
    return False


def _dominates(a: Pattern, b: Pattern, most: int = 10) -> bool:
    """Whether the items of ``b`` fit into the items of ``a`` as into bins (of more
    than ``most`` items it isn't tried, and both are kept)."""
    if sum(c for _, c in b) > most:
        return False
    return _fit([x for x, c in b for _ in range(c)], [x for x, c in a for _ in range(c)])


def _sums(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each place among ``lengths`` the sums within ``room`` that those from
    there on can make, as bits of a number."""
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in reversed(lengths):
        now, c, k = reach[-1], min(counts[x], room // x), 1
        while c > 0:  # any number up to c, by doubling
            k = min(k, c)
            now |= now << (k * x) & mask
            c, k = c - k, 2 * k
        reach.append(now)
    return reach[::-1]


def completions(room: int, counts: dict[int, int], keep: int = 4, spare: int = 0, price: int = 0, steps: int = 300) -> list[Pattern]:
    """Fillings of ``room`` of which none dominates another: of the fullest, and of
    those up to ``spare`` less full.  The best has least waste plus ``price`` for each
    item; among equals, that with the longest items, since short ones fit anywhere."""
    if counts.get(room):
        return [((room, 1),)]  # one item that fills the rest dominates all others
    lengths = sorted((x for x, c in counts.items() if c and x <= room), reverse=True)
    if not lengths:
        return [()]
    reach = _sums(lengths, counts, room)
    fullest, left = reach[0].bit_length() - 1, steps
    found: list[tuple[int, Pattern]] = []

    def fill(at: int, rest: int, chosen: Pattern, most: int) -> None:
        """Fillings that leave nothing of ``rest``, longest items first; no dead ends."""
        nonlocal left
        while rest and at < len(lengths):
            x, at = lengths[at], at + 1
            for c in range(min(counts[x], rest // x), 0, -1):
                if reach[at] >> (rest - c * x) & 1 and left > 0 and len(found) < most:
                    left -= 1
                    fill(at, rest - c * x, (*chosen, (x, c)), most)
            if not reach[at] >> rest & 1 or left <= 0 or len(found) >= most:
                return
        if not rest and not any(_dominates(f, chosen) for _, f in found):
            found.append((room - sum(x * c for x, c in chosen), chosen))

    for total in range(fullest, max(fullest - spare - 1, 0), -1):
        if reach[0] >> total & 1 and left > 0:
            fill(0, total, (), len(found) + keep)
    found.sort(key=lambda f: f[0] + price * sum(c for _, c in f[1]))
    return [f for _, f in found[:keep]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: items over half need a bin each, and what does not
    fit beside them needs more."""
    total = -(-sum(x * c for x, c in counts.items()) // capacity)
    for k in [0, *(x for x in counts if 2 * x <= capacity)]:
        big = sum(c for x, c in counts.items() if x > capacity - k)
        mid = [(x, c) for x, c in counts.items() if capacity - k >= x > capacity / 2]
        low = sum(x * c for x, c in counts.items() if capacity / 2 >= x >= k)
        n = sum(c for _, c in mid)
        total = max(total, big + n + max(0, -(-(low - (n * capacity - sum(x * c for x, c in mid))) // capacity)))
    return total


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Each bin filled with the largest that still fits, as often as possible."""
    counts, out = {x: c for x, c in counts.items() if c}, []
    while counts:
        room, pattern = capacity, {}
        for x in sorted(counts, reverse=True):
            if x <= room:
                pattern[x] = min(counts[x], room // x)
                room -= pattern[x] * x
        times = min(counts[x] // c for x, c in pattern.items())
        out.append((tuple(pattern.items()), times))
        for x, c in pattern.items():
            counts[x] -= c * times
            if not counts[x]:
                del counts[x]
    return out


#: (spare, price) of the searches, one after the other: at first always the fullest.
SEARCHES = ((0, 0), (16, 8), (8, 2), (4, 1), (32, 8), (16, 4), (12, 6), (24, 12))


def search_bins(counts: dict[int, int], capacity: int, best: list[tuple[Pattern, int]], nodes: int = 12_000) -> list[tuple[Pattern, int]]:
    """Bin completion: around the longest length left, each undominated filling is a
    branch, best first, applied as often as the counts allow; a branch whose waste is
    more than a better plan can have is cut.  ``best`` is the incumbent.  Several
    searches share the nodes, each with another price for short items."""
    bins = lambda plan: sum(m for _, m in plan)
    least, total = lower_bound(counts, capacity), sum(x * c for x, c in counts.items())
    for i, (spare, price) in enumerate(SEARCHES):
        budget = nodes // len(SEARCHES)
        # depth first; of a plan only its last filling is held at a node, with the node before
        stack: list[tuple[dict[int, int], tuple | None, int]] = [(counts, None, 0)]
        while stack and budget > 0 and bins(best) > least:
            left, path, waste = stack.pop()
            budget -= 1
            if waste > (bins(best) - 1) * capacity - total:
                continue
            if not left:
                best = []
                while path is not None:
                    filling, path = path
                    best.append(filling)
                continue
            top = max(left)
            rest = left | {top: left[top] - 1}
            for f in reversed(completions(capacity - top, rest, spare=spare, price=price)):
                pattern = dict(f)
                pattern[top] = pattern.get(top, 0) + 1
                times = min(left[x] // c for x, c in pattern.items())
                after = {x: n for x, c in left.items() if (n := c - pattern.get(x, 0) * times)}
                used = capacity - sum(x * c for x, c in pattern.items())
                stack.append((after, ((tuple(sorted(pattern.items(), reverse=True)), times), path), waste + used * times))
            del stack[:-400]
        if bins(best) <= least:
            break
    return best


def plan_bins(counts: dict[int, int], capacity: int, exchanges: bool = True) -> list[tuple[Pattern, int]]:
    """(filling, how many sequences), covering ``counts`` exactly: best fit, then
    bin completion, then, as an extra, exchanges among the loosest sequences."""
    counts = {int(x): int(c) for x, c in counts.items() if c}
    least, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    best = search_bins(counts, capacity, best)
    return exchange(best, capacity, least) if exchanges and sum(m for _, m in best) > least else best


def _fullest(items: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The items of a largest sum within the capacity, and the others: sums that
    can be reached are bits of a number, one number for each item more."""
    reach, mask = [1], (1 << (capacity + 1)) - 1
    for x in items:
        reach.append((reach[-1] | reach[-1] << x) & mask)
    left, inside, outside = reach[-1].bit_length() - 1, [], []
    for x, before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if before >> left & 1:
            outside.append(x)
        else:
            inside.append(x)
            left -= x
    return inside, outside


def exchange(
    plan: list[tuple[Pattern, int]], capacity: int, least: int, most: int = 600, rounds: int = 400_000, seed: int = 0
) -> list[tuple[Pattern, int]]:
    """Two or three of the loosest sequences (``most`` at most) at a time are
    emptied and filled anew, the first as full as can be, so that slack gathers
    until a sequence is left over."""
    loose: list[list[int]] = []
    kept: list[tuple[Pattern, int]] = []
    for pattern, times in sorted(plan, key=lambda p: sum(x * c for x, c in p[0])):
        n = min(times, most - len(loose)) if sum(x * c for x, c in pattern) < capacity else 0
        loose += [[x for x, c in pattern for _ in range(c)] for _ in range(n)]
        if times > n:
            kept.append((pattern, times - n))
    fixed, rng = sum(m for _, m in kept), random.Random(seed)
    for i in range(rounds):
        if len(loose) < 2 or fixed + len(loose) <= least:
            break
        chosen = rng.sample(range(len(loose)), min(2 + i % 2, len(loose)))
        rest = [x for j in chosen for x in loose[j]]
        if len(rest) > 60:
            continue
        rng.shuffle(rest)
        new = []
        for _ in chosen[1:]:
            inside, rest = _fullest(rest, capacity)
            new.append(inside)
        new.append(rest)
        if sum(rest) <= capacity and sum(sum(b) ** 2 for b in new) >= sum(sum(loose[j]) ** 2 for j in chosen):
            for j, b in zip(chosen, new, strict=True):
                loose[j] = b
            loose = [b for b in loose if b]
    patterns = collections.Counter(tuple(sorted(collections.Counter(b).items(), reverse=True)) for b in loose)
    return kept + list(patterns.items())


def pack(
    docs: DataFrame, capacity: int = 1024, key: str = "doc_id", text: str = "text", vocab: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken", end_id: int = 2, ids: bool = False
) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` and, with ``ids``, the piece's
    little-endian unsigned 32-bit ids."""
    spark = docs.sparkSession
    kt = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task, seen = ids_of(vocabulary(vocab), vocabulary(ranks)), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["_key"], pdf["_text"], strict=True):
                whole = np.append(enc.encode(t) if isinstance(t, str) and t else np.zeros(0, "<u4"), np.uint32(end_id)).astype("<u4")
                for i, (s, n) in enumerate(spans(len(whole), capacity)):
                    b = whole[s : s + n].tobytes()
                    rows.append((k, i, s, n, zlib.crc32(b), task, seen[n], b if ids else None))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["_key", "piece", "start", "length", "ids_crc32", "_task", "_nth", "ids"])

    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    pieces = stage(
        source.mapInPandas(cut, f"_key {kt}, piece int, start long, length long, ids_crc32 long, _task int, _nth long, ids binary"), "pieces",
        rows_at_once=1000
    )

    per_task = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan, rows, sequence, used = plan_bins(counts, capacity), [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan:
        offset = 0
        for x, c in pattern:
            rows.append((x, used[x], used[x] + c * times, sequence, c, offset))
            used[x] += c * times
            offset += c * x
        sequence += times
    # broadcast: each filling uses up a length, so there are at most `capacity` of them (and 600 by exchange), each of at most
    # the square root of twice the capacity in distinct lengths, however many pieces there are
    schema = "length long, _from long, _to long, _sequence long, _each long, _offset long"
    ways = F.broadcast(spark.createDataFrame(rows, schema))

    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_task", "length", "_base")
    ranked = pieces.join(bases, ["_task", "length"]).withColumn("_rank", F.col("_base") + F.col("_nth"))
    placed = ranked.join(ways, "length").filter("_rank >= _from AND _rank < _to")
    within = F.col("_rank") - F.col("_from")
    placed = placed.select(
        F.col("_key").alias(key), "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.floor(within / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_offset") + within % F.col("_each") * F.col("length")).cast("long").alias("offset"), *(["ids"] if ids else [])
    )
    out = stage(placed, "packed")
    drop(pieces)
    return out
