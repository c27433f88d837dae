"""Exact Jaccard join of word n-gram sets, down to the components of its links.

1. *Rows that can link.*  Sets are ordered by hash.  If x and y link, each holds
   at least o(x) = ceil(t |x|) common elements, so by the pigeonhole their first
   |x| - o(x) + l elements have l in common (l a fixed share of the size).  Only
   these prefixes travel, packed by hash range, with elements that repeat within
   a batch already merged; a row is kept if enough of its prefix occurs in other
   rows.  Nothing that has a link is lost.
2. *Tiles.*  Rows of like sizes share a tile.  Linked sets of a tile differ in at
   most D elements, so of more than D hashed parts of the sets at least one is
   equal: rows meet where they have an equal part.  There are 1.4 D parts, so
   that nearly all sets have elements in more than D of them, and empty parts,
   which unrelated sets have in common, need not be compared.
3. *Bounds, then intersection.*  Each set has a hashed bitmap of parities; the
   bits in which two differ are at most the elements in which the sets differ,
   which bounds the overlap from above.  Pairs that pass are intersected as
   sorted arrays.
4. *Links.*  Rows that share a part are first compared with one of them, which
   joins groups of near copies in as many comparisons as rows.  What then is
   outside the part's commonest component is compared with all of the part, block
   by block, so that no pair of different components remains unseen.

Equal texts are one row throughout.  Hot parts are split into
blocks of fixed size.  Elements are 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Null, empty and blank
texts have no set and link with nothing; with fewer words than n, the whole
sequence is the one element.  Repeated rows give repeated rows; null keys are
kept and never the least.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, drop, join_skewed, stage
from tidemark.llm.components import components

U = np.uint64
BITS = 1024
BLOCK = 256
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, U(base))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of lower-cased bytes: a polynomial in the
    bytes, from differences of prefix sums."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.to(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * up[:-1])])
    return start, _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def shingle_sets(texts: list[str | None], n: int, most: int = 1 << 20) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams.  Texts are hashed
    together up to ``most`` bytes; longer ones are hashed in runs of words."""
    out: list[np.ndarray] = []
    at = 0
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    weights = _mix(np.arange(1, n + 1, dtype=U)) | U(1)
    while at < len(data):
        upto, size = at + 1, len(data[at])
        while upto < len(data) and size + len(data[upto]) < most:
            size += len(data[upto]) + 1
            upto += 1
        part = data[at:upto]
        raw = np.frombuffer(b" ".join(part), np.uint8)
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        if len(raw) > 4 * most:  # one long text: hash it by runs that end at a gap
            gaps = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
            cuts = [
                0, *gaps[np.unique(np.searchsorted(gaps, np.arange(most, len(raw), most)).clip(0, max(len(gaps) - 1, 0)))].tolist(), len(raw)
            ] if len(gaps) else [0, len(raw)]
            hashes = np.concatenate([_words(raw[s:e])[1] for s, e in zip(cuts, cuts[1:], strict=False)])
            owner = np.zeros(len(hashes), np.int64)
        else:
            start, hashes = _words(raw)
            owner = np.searchsorted(np.cumsum([len(d) + 1 for d in part]), start, "right")
        m = len(hashes) - n + 1
        if m > 0:
            total = np.zeros(m, U)
            for j in range(n):
                total += hashes[j : j + m] * weights[j]
            total = _mix(total)
        words = np.searchsorted(owner, np.arange(len(part) + 1))
        for i in range(len(part)):
            s, e = words[i], words[i + 1]
            if e - s >= n:
                out.append(np.unique(total[s : e - n + 1]))
            elif e > s:
                out.append(_mix(np.array([int((hashes[s:e] * weights[: e - s]).sum()) & (2**64 - 1)], U) + U(e - s)))
            else:
                out.append(np.zeros(0, U))
        at = upto
    return out


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        # bands of sizes, one partner ratio wide
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, edges[-1] * den // num))
        self.edges = np.array(edges, np.int64)

    def least(self, n: int) -> int:
        """What a set of n has in common with any partner, at least."""
        return -(-self.num * n // self.den)

    def spare(self, n: int) -> int:
        return max(1, (self.den - self.num) * n // self.den)

    def prefix(self, n: int) -> int:
        return min(n, n - self.least(n) + self.spare(n))

    def tiles(self, n: int) -> list[tuple[int, int]]:
        """(tile, D) of a set of n: a pair meets in the tile of the smaller, where
        linked sets differ in at most D elements."""
        b = int(np.searchsorted(self.edges, n, "right")) - 1
        out = [b] if b == 0 or self.least(n) >= self.edges[b] else [b - 1, b]
        return [(t, self._apart(int(self.edges[t + 1]) - 1)) for t in out]

    def _apart(self, size: int) -> int:
        """Most elements in which a set of ``size`` and a larger partner differ."""
        return (size + size * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def enough(self, common, a, b):
        return common * (self.den + self.num) >= self.num * (a + b)


def parity_bitmap(h: np.ndarray) -> bytes:
    """Whether an odd number of elements falls on each of a power of two of
    bits, no fewer than there are elements: else two large sets would differ in
    half of the bits whatever they hold."""
    bits = max(BITS, 1 << max(0, len(h) - 1).bit_length())
    bit = (_mix(h ^ U(0x5851F42D4C957F2D)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of ``size`` bytes: halves of longer ones are added."""
    rows = []
    for b in bitmaps:
        a = np.frombuffer(b, "<u8")
        rows.append(a if len(b) == size else np.bitwise_xor.reduce(a.reshape(len(b) // size, -1), axis=0))
    return np.stack(rows)


def part_hashes(h: np.ndarray, tile: int, apart: int) -> np.ndarray:
    """A hash of what of the set falls into each part.  Sets that differ in at
    most ``apart`` elements differ in as many parts at most; so if a set has
    elements in more parts than that, one of these is found in its partner, and
    only they are given.  Else the empty parts are needed as well."""
    parts = apart + 2 * apart // 5 + 1
    m = _mix(h + U(0x2545F4914F6CDD1D))
    part = (m % U(parts)).astype(np.int64)
    sums = np.zeros(parts, U)
    np.add.at(sums, part, _mix(m))
    seed = _mix(np.arange(parts, dtype=U) + U(tile) * U(1 << 32) + U(1))
    held = np.bincount(part, minlength=parts)
    out = _mix(sums + seed + held.astype(U) * U(_BASE))
    return out[held > 0] if np.count_nonzero(held) > apart else out


def link_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_shingles``, ``component_id``: the least
    key of the rows reachable by links, itself included."""
    spark = docs.sparkSession
    t = Threshold(num, den)
    kt = docs.schema[key].dataType.simpleString()
    # ranges of hashes: a task takes one as a whole, so there is one for each 64 MB of text at least
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = docs.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string")).cast("long")), F.lit(0)).alias("bytes")
    ).first()
    ranges = max(2 * max(4, partitions), facts["bytes"] >> 26)
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.unhex(F.md5("t")))

    # 1. prefixes by hash range (range >= 0), and the rows themselves (range -1)
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets(pdf["t"].tolist(), n)
            sizes = np.array([len(s) for s in sets], np.int64)
            heads = [s[: t.prefix(len(s))] for s in sets]
            h = np.concatenate(heads) if heads else np.zeros(0, U)
            who = np.repeat(np.arange(len(sets)), [len(x) for x in heads])
            order = np.argsort(h, kind="stable")
            h, who = h[order], who[order]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(h)))
            met = np.bincount(who[np.repeat(times > 1, times)], minlength=len(sets))
            one = np.where(times > 1, -1, who[first]).astype("<i4")  # whom to tell, if it is met elsewhere
            u = h[first]
            bucket = (u >> U(32)).astype(np.int64) * ranges >> 32
            at = np.searchsorted(bucket, np.arange(ranges + 1))
            start = int(pdf["rid"].iloc[0]) if len(pdf) else 0
            shift = (pdf["rid"].to_numpy() - start).astype("<i8")
            rows = [
                (
                    b, start, u[s:e].astype("<u8").tobytes(), shift[one[s:e]].astype("<i4").tobytes(), (one[s:e] < 0).astype(np.uint8).tobytes(),
                    None, None, None, None, None
                ) for b,
                (s, e) in enumerate(zip(at, at[1:], strict=False)) if e > s
            ]
            rows.append((-1, start, None, None, None, pdf["rid"].tolist(), pdf["k"].tolist(), pdf["h"].tolist(), sizes.tolist(), met.tolist()))
            yield pd.DataFrame(rows, columns=["range", "start", "hashes", "who", "many", "rids", "ks", "hs", "ns", "cs"])

    packed = stage(
        base.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(
            sketch,
            f"range int, start long, hashes binary, who binary, many binary, rids array<long>, ks array<{kt}>, hs array<binary>, ns array<long>, cs array<long>"
        ),
        "prefixes",
        rows_at_once=1000,
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(b, "<u8") for b in pdf["hashes"]])
        lens = [len(b) // 8 for b in pdf["hashes"]]
        who = np.concatenate([np.frombuffer(b, "<i4") for b in pdf["who"]])
        starts = pdf["start"].to_numpy()
        owner = np.repeat(np.arange(len(starts)), lens)
        many = np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["many"]]).astype(bool)
        order = np.argsort(h, kind="stable")
        h, who, many = h[order], who[order], many[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(first, len(h)))
        hit = np.repeat(times > 1, times) & ~many
        told, c = np.unique(
            np.stack([owner[order][hit], who[hit]]), axis=1, return_counts=True
        ) if hit.any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        of, ends = np.unique(told[0], return_index=True)
        ends = np.append(ends, told.shape[1])
        out = [(starts[o], told[1, s:e].astype("<i4").tobytes(), c[s:e].astype("<i4").tobytes()) for o, s, e in zip(of, ends, ends[1:], strict=False)]
        return pd.DataFrame(out, columns=["start", "at", "c"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """A batch's rows that occur in others often enough."""
        own = pdf[pdf["ns"].notna()].iloc[0]
        size, met, rid = np.array(own["ns"], np.int64), np.array(own["cs"], np.int64), np.array(own["rids"], np.int64)
        for at, c in zip(pdf["at"], pdf["c"], strict=True):
            if at is not None:
                np.add.at(met, np.frombuffer(at, "<i4"), np.frombuffer(c, "<i4"))
        least = -(-num * size // den)
        keep = np.flatnonzero((size > 0) & (met >= np.maximum(1, (den - num) * least // den)))
        return pd.DataFrame({"rid": rid[keep], "k": [own["ks"][i] for i in keep], "h": [own["hs"][i] for i in keep]})

    told = packed.filter("range >= 0").select("range", "start", "hashes", "who", "many").groupBy("range").applyInPandas(meet, "start long, at binary, c binary")
    batch = packed.filter("range = -1").select("start", "rids", "ks", "hs", "ns", "cs")
    rows = stage(
        batch.select(F.explode(F.arrays_zip("rids", "ks", "hs", "ns")).alias("z")).select(
            F.col("z.rids").alias("rid"), F.col("z.ks").alias("k"), F.col("z.hs").alias("h"), F.col("z.ns").alias("n")
        ),
        "rows"
    )
    both = batch.unionByName(told, allowMissingColumns=True)
    kept = both.groupBy("start").applyInPandas(settle, f"rid long, k {kt}, h binary")
    # one row for each text
    texts = stage(
        kept.groupBy("h").agg(
            F.min(F.struct("k", "rid")).alias("a"), F.min("k").alias("least"), F.count("*").alias("copies")
        ).select("h", "a.k", "a.rid", "least", "copies"),
        "kept-texts"
    )
    drop(packed)

    # 2. sets of what is kept
    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets(pdf["t"].tolist(), n)
            yield pd.DataFrame({
                "rid": pdf["rid"], "h": pdf["h"], "n": [len(s) for s in sets], "bits": [parity_bitmap(s) for s in sets],
                "hashes": [s.astype("<u8").tobytes() for s in sets]
            })

    found = base.alias("d").join(
        broadcast_if_small(texts).alias("x"), (F.col("d.h") == F.col("x.h")) & F.col("d.k").eqNullSafe(F.col("x.k"))
    ).select("x.rid", "d.h", "d.t")
    sets = stage(found.mapInPandas(to_sets, "rid long, h binary, n long, bits binary, hashes binary"), "sets", rows_at_once=1000)
    light = sets.select("rid", "n", "bits").dropDuplicates(["rid"])  # rows of equal key and text are found twice

    # 3. parts that sets have in common
    def to_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rids, keys = [], []
            for rid, size, raw in zip(pdf["rid"], pdf["n"], pdf["hashes"], strict=True):
                s = np.frombuffer(raw, "<u8").astype(U)
                for tile, apart in t.tiles(int(size)):
                    k = part_hashes(s, tile, apart)
                    keys.append(k.view(np.int64))
                    rids.append(np.full(len(k), rid, np.int64))
            yield pd.DataFrame({"part": np.concatenate(keys) if keys else [], "rid": np.concatenate(rids) if rids else []}).astype(np.int64)

    parts = stage(sets.select("rid", "n", "hashes").mapInPandas(to_parts, "part long, rid long"), "parts", rows_at_once=1000)
    leaders = parts.groupBy("part").agg(F.min("rid").alias("lead"), F.max("rid").alias("last")).filter("lead <> last").drop("last")
    shared = stage(parts.join(leaders, "part"), "shared-parts")
    drop(parts)

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            least = np.minimum(pdf["bits_a"].map(len), pdf["bits_b"].map(len))
            for size, part in pdf.groupby(least.to_numpy()):
                a, b = (fold(part[c].tolist(), int(size)) for c in ("bits_a", "bits_b"))
                na, nb = part["n_a"].to_numpy(), part["n_b"].to_numpy()
                apart = np.bitwise_count(a ^ b).sum(1).astype(np.int64)
                ok = t.enough(np.minimum((na + nb - apart) // 2, np.minimum(na, nb)), na, nb)
                yield part.loc[ok, ["a", "b"]]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                ok.append(bool(t.enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    side = lambda df, c, *more: df.select(F.col("rid").alias(c), *more)

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs that passed the bitmap bound.  Only the sets of
        those pairs travel."""
        pairs = stage(pairs.distinct(), "pairs")
        needed = stage(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(), "needed")
        has = sets.select("rid", "hashes").join(broadcast_if_small(needed), "rid", "left_semi").dropDuplicates(["rid"])
        out = stage(
            pairs.join(side(has, "a", F.col("hashes").alias("x")), "a").join(side(has, "b", F.col("hashes").alias("y")), "b").select("a", "b", "x", "y").mapInPandas(exact, "a long, b long"),
            "links"
        )
        drop(pairs, needed)
        return out.select(F.col("a").alias("u"), F.col("b").alias("v"))

    pairs = shared.filter("rid <> lead").select(F.col("lead").alias("a"), F.col("rid").alias("b")).distinct()
    pairs = pairs.join(
        side(light, "a", F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a"
    ).join(side(light, "b", F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b").mapInPandas(bounded, "a long, b long")
    labels = stage(components(verified(pairs)), "labels")

    # 4. rows of one part in different components.  Those of its commonest component need no comparison among
    # themselves: the others (the minor ones) meet them and each other, block by block
    placed = shared.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("part", "rid", F.coalesce("label", "rid").alias("label"))
    tally = placed.groupBy("part", "label").agg(F.count("*").alias("c"))
    apart = tally.groupBy("part").agg(
        F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size"), F.count("*").alias("labels")
    ).filter("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    apart = apart.select(
        "part", F.col("top.label").alias("major"), blocks(F.col("top.c")).alias("majors"), blocks(F.col("size") - F.col("top.c")).alias("minors")
    )
    open_ = placed.join(apart, "part").withColumn("minor", F.col("label") != F.col("major")).join(light, "rid")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("rid"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    # tile (i, j) with j < 0: minor block i and major block -1 - j; else minor blocks i and j >= i
    against = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j")))
    among = F.transform(
        F.sequence(F.lit(0), F.col("minors") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))
    )
    faced = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j")))
    tiles = open_.withColumn(
        "tile", F.explode(F.when(F.col("minor"), F.concat(against, among)).otherwise(faced))
    ).select("part", "tile.i", "tile.j", "block", "minor", "rid", "label", "n", "bits")

    def passing(rid, label, size, bitmaps, block, minor, i, j) -> list[tuple[int, int]]:
        """Pairs of one tile that may link, in different components."""
        bits, out = fold(bitmaps, min(map(len, bitmaps))), []
        cross = i != j
        for a in np.flatnonzero(minor):
            # minor rows meet the major ones, or the other block, or those after them in their own
            b = ~minor if j < 0 else (block != block[a]) if cross else (np.arange(len(rid)) > a)
            if cross and j >= 0 and block[a] != i:
                continue
            b = np.flatnonzero(b & (label != label[a]) & (num * np.maximum(size, size[a]) <= den * np.minimum(size, size[a])))  # no larger partner
            if len(b):
                small, gap = np.minimum(size[b], size[a]), np.bitwise_count(bits[b] ^ bits[a]).sum(1).astype(np.int64)
                for k in b[t.enough(np.minimum((size[a] + size[b] - gap) // 2, small), size[a], size[b])]:
                    out.append((min(rid[a], rid[k]), max(rid[a], rid[k])))
        return out

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles one after another: rows come sorted by tile, and the last tile
        of a batch may go on in the next."""
        rest = None
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if rest is None or not len(rest):
                continue
            where = rest[["part", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            ends = [0, *cuts.tolist(), *([len(rest)] if pdf is None else [])]
            bits = rest["bits"].tolist()
            columns = [rest[c].to_numpy() for c in ("rid", "label", "n", "block", "minor")]
            out = []
            for s, e in zip(ends, ends[1:], strict=False):
                if e - s > 1:
                    rid, label, size, block, minor = (c[s:e] for c in columns)
                    out += passing(rid, label, size, bits[s:e], block, minor, int(where[s, 1]), int(where[s, 2]))
            yield pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype(np.int64)
            rest = rest.iloc[ends[-1] :].reset_index(drop=True)

    more = tiles.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInPandas(compare, "a long, b long")
    rest = verified(more)
    if rest.limit(1).count():
        labels = stage(components(rest.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))), "labels")

    # components of texts, then of rows: a hot text's rows, or a hot component's texts, meet in no single task
    named = texts.select("h", "rid", "least", "copies").join(labels.withColumnRenamed("node", "rid"), "rid", "left").select(
        "h", "least", "copies", F.coalesce("label", "rid").alias("label")
    )
    most = max(1000, facts["n"] // (8 * partitions))
    groups = named.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("texts"))
    named = stage(join_skewed(named, stage(groups, "components"), "label", "texts", most).select("h", "component", "copies"), "named-texts")
    whole = join_skewed(rows.select("k", "n", F.when(F.col("n") > 0, F.col("h")).alias("h")), named, "h", "copies", most)
    out = stage(whole.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component_id")), "components")
    drop(rows, texts, sets, shared, labels, named)
    return out
