"""Merkle manifest of a dataset: a tree of rows per source, a tree of sources
above it, and for every row the proof that it belongs to the root.

1. *Leaves.*  A row is known by the SHA-256 of its columns, each ``-`` if null,
   else its length in bytes, ``:`` and its value.  Rows are put in order by range
   partitioning (source, id, digest), and their places within a source are told
   from the counts of (partition, source) pairs, so that no source is one task's.
2. *Levels, bottom-up.*  Runs of ``fan`` nodes become their parent, a level at a
   time.  A level is a table of its own: place, digest and the children's digests.
   A source's last node is its subroot; subroots, in order of source, are the
   leaves of the upper tree.
3. *Proofs, top-down.*  Children join their parents on the parent's place (at most
   ``fan`` rows a key); each puts its own siblings before the proof that the
   parent has inherited.  A step of a proof holds the siblings to the left and
   those to the right, so that folding needs nothing else.

Native functions only.  Null columns are part of the digest; null sources come
first and are a source of their own, null ids come first in theirs; rows alike in
all columns are leaves of their own, next to each other.  A source of one row is
its own subroot, a table of one source has its subroot as root, and a table of one
row has no siblings at all (an empty proof).  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, drop, ordered, part_offsets, running_start, stage

FAN = 3
PROOF = "array<struct<before:string,after:string>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value with its length before it, or ``-``: no two rows look alike."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """A row's digest, with some columns replaced."""
    return digest(*[field(changed.get(c, F.col(c))) for c in COLUMNS])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, start, lambda own, s: F.sha2(F.concat(s["before"], own, s["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """One digest of a whole proof: all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def _levels(nodes: DataFrame, fan: int, name: str) -> list[DataFrame]:
    """All levels above ``nodes`` (tree, place, n: the tree's nodes on that level,
    digest), each staged with its children's digests."""
    out, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = nodes.filter(F.col("n") > 1).groupBy("tree", F.floor(F.col("place") / fan).cast("long").alias("up"))
        kids = runs.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("k"))
        kids = kids.select(
            "tree", F.col("up").alias("place"), F.ceil(F.col("n") / fan).cast("long").alias("n"), F.col("k.digest").alias("kids")
        )
        level = kids.withColumn("digest", F.sha2(F.array_join("kids", "").cast("binary"), 256))
        nodes, most = stage(level, f"{name}-level"), -(-most // fan)
        out.append(nodes)
    return out


def _proofs(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fan: int, name: str) -> DataFrame:
    """``nodes`` with ``head`` and ``proof``, staged.  ``tops`` (tree, head, proof) is what
    each tree's last node starts with; from there each level inherits from the one
    above, and each child puts its own siblings before what it inherits."""
    above = None
    for k, level in enumerate([*reversed(levels), nodes]):
        done = level.filter("n = 1").join(tops, "tree")
        if above is not None:
            parents = above.select("tree", F.col("place").alias("up"), F.col("kids").alias("siblings"), "head", F.col("proof").alias("upper"))
            met = level.filter("n > 1").withColumn("up", F.floor(F.col("place") / fan).cast("long")).join(parents, ["tree", "up"])
            at = (F.col("place") % fan).cast("int")
            own = F.struct(
                F.array_join(F.slice("siblings", F.lit(1), at), "").alias("before"), F.array_join(F.slice("siblings", at + 2, F.lit(fan)), "").alias("after")
            )
            met = met.withColumn("proof", F.concat(F.array(own), "upper"))
            done = done.unionByName(met.select(*level.columns, "head", "proof"))
        before, above = above, stage(done, f"{name}-proofs")
        drop(before)
    return above


def manifest(rows: DataFrame, leaf: Column, *keep: Column, key: str = "doc_id", source: str = "source", fan: int = FAN) -> DataFrame:
    """Per row of ``rows``: the columns ``keep``, leaf, subroot, root and proof (steps of
    siblings before and after, from the leaf's level up to the root's)."""
    src = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("-"))  # null comes first, and equals itself
    small = rows.select(F.col(key).alias("_key"), src.alias("_src"), leaf.alias("digest"), F.struct(*keep).alias("_keep"))
    at = ordered(small, F.col("_src"), F.col("_key").asc_nulls_first(), F.col("digest"), name="leaves")
    # a source's rows in a part, and in the parts before; its first place among all
    # rows names its tree, and rises with the source
    counts = at.groupBy("_part", "_src").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n")).join(part_offsets(at, F.lit(1)), "_part")
    own = Window.partitionBy("_src").orderBy("_part")
    shares = counts.select(
        "_part", "_src", "_first", F.coalesce(F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
        F.sum("_n").over(Window.partitionBy("_src")).alias("n"), F.min(F.col("_before") + F.col("_first")).over(Window.partitionBy("_src")).alias("tree")
    )
    shares = stage(shares, "shares")
    place = (F.col("_earlier") + F.col("_pos") - F.col("_first")).alias("place")
    leaves = stage(at.join(broadcast_if_small(shares), ["_part", "_src"]).select("tree", place, "n", "digest", "_keep"), "placed-leaves")
    drop(at, shares)
    levels = _levels(leaves, fan, "rows")

    subroots = leaves.filter("n = 1").select("tree", "digest")
    for level in levels:
        subroots = subroots.unionByName(level.filter("n = 1").select("tree", "digest"))
    numbered = running_start(subroots.withColumn("_one", F.lit(1)), ["tree"], "_one", "place")
    sources = numbered.select(F.lit(0).cast("long").alias("tree"), "place", F.lit(numbered.count()).cast("long").alias("n"), "digest", F.col("tree").alias("_of"))
    upper = _levels(sources, fan, "sources")
    top = (upper[-1] if upper else sources).filter("n = 1")
    top = stage(top.select("tree", F.struct(F.col("digest").alias("root")).alias("head"), F.array().cast(PROOF).alias("proof")), "root")
    found = _proofs(sources, upper, top, fan, "sources")
    heads = stage(found.select(F.col("_of").alias("tree"), F.struct(F.col("digest").alias("subroot"), "head.root").alias("head"), "proof"), "heads")
    out = _proofs(leaves, levels, heads, fan, "rows")
    drop(numbered, *upper, top, found, heads, leaves, *levels)
    return out.select("_keep.*", F.col("digest").alias("leaf"), "head.subroot", "head.root", "proof")


def verify(rows: DataFrame, tampered: Column) -> DataFrame:
    """The manifest of ``documents``, held against the same rows with their texts
    replaced by ``tampered``."""
    made = manifest(rows, leaf_digest(), F.col("doc_id"), leaf_digest(text=tampered).alias("_now"))
    folded = fold(F.col("_now"), F.col("proof"))
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
