"""Document fingerprints by consistent weighted sampling.

A document's terms are its lower-cased words, weighted by how often they occur.
For each of ``samples`` draws a term gets r and c from Gamma(2, 1) and b from
(0, 1), all functions of the term and the draw alone; with the weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1), and the draw picks the
term of smallest a.  Two documents pick alike with the probability of their
generalised Jaccard similarity, sum of least weights over sum of largest.  Since
a is a function of the term, t and the draw, the least a itself stands for the
pick: a fingerprint is 24 bits of its hash per draw, in hex.

``neighbours`` also fingerprints each text after its last third was replaced by
the head of the next document's text, in descending key order, the last being
followed by the first.  Texts are shuffled once, to key ranges; the next text
then is the next row of a range, or the first of the range that follows.

Null text is empty; a text without words has a fingerprint of its own, like only
to others without words.  Repeated keys are ordered by hash of the text, then by
text, and a key of many rows is spread over ranges by that hash (rows equal in key
and text share one); null keys come last; repeated rows stay rows.  A table of one row is its own next document; an
empty table gives no rows.  Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop, stage
from tidemark.plans.order import place_among

WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: Fingerprints' hex digits per draw
DIGITS = 6


def draws(term: Column, log_weights: list[Column], samples: int) -> list[list[Column]]:
    """ln a of each draw for a hashed term under each weight (null: no such
    term): two 64-bit hashes give five numbers in (0, 1), and the logarithm of a
    product of two uniform ones is minus a Gamma(2, 1).  Weights share them."""
    out = []
    low, mid = (1 << 25) - 1, 2.0**-25
    for i in range(samples):
        g, h = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
        u = lambda x, s: (F.shiftrightunsigned(x, s).bitwiseAND(F.lit(low)) + F.lit(0.5)) * F.lit(mid)  # noqa: B023, E731
        r = -F.ln(u(g, 0) * u(g, 25))
        c = F.ln(-F.ln(u(h, 0) * u(h, 25)))
        b = (F.shiftrightunsigned(g, 50) * F.lit(16384) + F.shiftrightunsigned(h, 50) + F.lit(0.5)) * F.lit(2.0**-28)
        out.append([c - r * (F.floor(w / r + b) - b + F.lit(1.0)) for w in log_weights])
    return out


@contextmanager
def split_methods(spark) -> Iterator[None]:
    """While a plan with this many draws runs: generated methods that are too
    large for the JVM's compiler are split instead (some five times faster)."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pick(least: Column) -> Column:
    """A draw's pick in hex; of no words, all zeros."""
    return F.lpad(F.hex(F.coalesce(F.xxhash64(least), F.lit(0)).bitwiseAND(F.lit((1 << (4 * DIGITS)) - 1))), DIGITS, "0")


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal picks of two fingerprints."""
    parts = [F.when(F.substring(a, 1 + i * DIGITS, DIGITS) == F.substring(b, 1 + i * DIGITS, DIGITS), 1).otherwise(0) for i in range(samples)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / F.lit(float(samples))


def _fingerprints(rows: DataFrame, ids: list[str], kinds: dict[str, Column], samples: int) -> DataFrame:
    """``rows`` of ``ids``, ``w`` (a word) and what the kinds use, placed so that
    grouping by the ids needs no exchange: per ids a fingerprint for each kind,
    whose column says how often a row's word counts."""
    counts = [F.sum(c).alias(f"n_{k}") for k, c in kinds.items()]
    hashed = rows.withColumn("w", F.when(F.col("w") != "", F.xxhash64("w")))
    terms = hashed.groupBy(*ids, "w").agg(*counts)
    known = F.col("w").isNotNull()
    logs = [F.when(known & (F.col(f"n_{k}") > 0), F.ln(F.col(f"n_{k}").cast("double"))).alias(f"l_{k}") for k in kinds]
    drawn = draws(F.col("w"), [F.col(f"l_{k}") for k in kinds], samples)
    values = terms.select(*ids, "w", *logs).select(*ids, *[d.alias(f"{k}_{i}") for i, ds in enumerate(drawn) for k, d in zip(kinds, ds, strict=True)])
    least = values.groupBy(*ids).agg(*[F.min(f"{k}_{i}").alias(f"{k}_{i}") for i in range(samples) for k in kinds])
    return least.select(*ids, *[F.concat(*[pick(F.col(f"{k}_{i}")) for i in range(samples)]).alias(k) for k in kinds])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = 32) -> DataFrame:
    """``key`` and ``fingerprint`` for each row."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("rid", F.monotonically_increasing_id())
    words = rows.select("rid", "k", F.explode(F.split(F.lower("t"), WORD_GAP)).alias("w"))
    with split_methods(docs.sparkSession):
        return stage(
            _fingerprints(words, ["rid", "k"], {"fingerprint": F.lit(1)}, samples).select(F.col("k").alias(key), "fingerprint"), "fingerprints"
        )


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = 32, ranges: int | None = None) -> DataFrame:
    """Per row: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.  The key is an
    integer column."""
    spark = docs.sparkSession
    # null keys come below all others
    least = Decimal(-(1 << 63) - 1)
    o = F.coalesce(F.col(key).cast("decimal(20,0)"), F.lit(least).cast("decimal(20,0)"))
    rows = docs.select(o.alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # key ranges of about equal size; their bounds are a fixed number of keys
    n = ranges or min(8192, 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = docs.select(F.percentile_approx(o, [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] if n > 1 else None
    times = sorted(Counter(cuts or []).items())
    # a key that is several of the bounds has as many ranges of its own, by hash of the text; before them come the keys below it
    start = list(accumulate((1 + (m if m > 1 else 0) for _, m in times), initial=0))
    at = place_among(F.col("o"), [F.lit(c).cast("decimal(20,0)") for c, _ in times])
    place = rows.select("o", "t", at.alias("at"))
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("at"))
    if times:
        hot = (of([m for _, m in times]) > 1) & (of([c for c, _ in times]).cast("decimal(20,0)") == F.col("o"))
        share = F.least(F.floor((F.xxhash64("t") / F.lit(2.0**64) + 0.5) * of([m for _, m in times])), of([m for _, m in times]) - 1).cast("int")
        rows = place.select(
            (F.get(F.array(*[F.lit(x) for x in start]), F.col("at")) + F.when(F.coalesce(hot, F.lit(False)), 1 + share).otherwise(0)).alias("range"),
            "o", "t"
        )
    else:
        rows = place.select(F.lit(0).alias("range"), "o", "t")
    # the key is read off its order, so that both uses below share one exchange

    # the first text of each range, under the range before it in descending order
    order = F.struct("o", F.xxhash64("t"), "t")
    firsts = stage(rows.groupBy("range").agg(F.max(order).alias("first")), "range-firsts")
    down = Window.orderBy(F.desc("range"))  # one row per range, without its text
    ring = firsts.select("range").withColumn("after", F.coalesce(F.lead("range").over(down), F.max("range").over(Window.partitionBy())))
    heads = ring.join(firsts.select(F.col("range").alias("after"), F.col("first.t").alias("head")), "after").select("range", "head")

    inside = Window.partitionBy("range").orderBy(F.desc("o"), F.desc(F.xxhash64("t")), F.desc("t"))
    placed = rows.withColumn("pos", F.row_number().over(inside)).withColumn("next", F.lead("t").over(inside))
    placed = placed.join(heads, "range", "left").withColumn("next", F.coalesce("next", "head", F.lit(""))).drop("head")
    third = F.floor(F.length("t") / 3).cast("int")
    both = placed.withColumn("edited", F.concat(F.substring("t", F.lit(1), F.length("t") - third), F.substring("next", F.lit(1), third)))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("t").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    words = both.select("range", "pos", F.explode(kinds).alias("z")).select(
        "range", "pos", "z.kind", F.explode(F.split(F.lower("z.t"), WORD_GAP)).alias("w")
    )
    prints = _fingerprints(words, ["range", "pos"], {"fingerprint": 1 - F.col("kind"), "edited_fingerprint": F.col("kind")}, samples)
    facts = both.select(
        "range", "pos", F.when(F.col("o") != F.lit(least).cast("decimal(20,0)"), F.col("o")).cast(docs.schema[key].dataType).alias("k"),
        F.length("t").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    )
    with split_methods(spark):
        done = stage(prints.join(facts, ["range", "pos"]), "fingerprints")

    # the next document's fingerprint, in the same way; rows are short now
    lead_first = done.filter("pos = 1").select(F.col("range").alias("after"), F.col("fingerprint").alias("head"))
    heads = ring.join(lead_first, "after").select("range", "head")
    by_pos = Window.partitionBy("range").orderBy("pos")
    out = done.withColumn("next", F.lead("fingerprint").over(by_pos)).join(heads, "range", "left").withColumn("next", F.coalesce("next", "head"))
    out = out.select(
        F.col("k").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(
            F.col("fingerprint"), F.col("edited_fingerprint"), samples
        ).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next"), samples).alias("near_next"),
    )
    out = stage(out, "likenesses")
    drop(firsts, done)
    return out
