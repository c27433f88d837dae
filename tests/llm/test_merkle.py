"""The Merkle manifest against a plain tree, on hot sources, nulls, repeated rows
and tables of no, one and few rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, place int, tree string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(digests, fan):
    """(root, each leaf's steps of siblings before and after)"""
    steps, owners, level = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(level) > 1:
        runs = [range(i, min(i + fan, len(level))) for i in range(0, len(level), fan)]
        for run in runs:
            for k in run:
                for i in owners[k]:
                    steps[i].append(("".join(level[run.start : k]), "".join(level[k + 1 : run.stop])))
        owners = [[i for k in run for i in owners[k]] for run in runs]
        level = [sha("".join(level[k] for k in run)) for run in runs]
    return level[0], steps


def plain(rows, tampered, fan=3):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(r))):
        by.setdefault(r[1], []).append(r)
    parts = [tree([leaf_of(r) for r in own], fan) for own in by.values()]
    root, upper = tree([p[0] for p in parts], fan) if parts else (None, [])
    out = []
    for own, (sub, steps), above in zip(by.values(), parts, upper, strict=True):
        for r, mine in zip(own, steps, strict=True):
            proof = mine + above
            now = leaf_of(r[:4] + (tampered(r),))
            for before, after in proof:
                now = sha(before + now + after)
            out.append((r[0], leaf_of(r), sub, root, sha("".join(a + b for a, b in proof)), now, now == root))
    return sorted(out, key=str)


def unbroken(r):
    return None if r[4] is None else r[4].replace("\n", "") if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]


def check(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = merkle.verify(df, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, unbroken)


def test_hot_source_nulls_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, "hot", "en", 3, f"line {i}\nline") for i in rng.sample(range(10_000), 130)]
    rows += [(i, rng.choice(["a", "é", "z", "", None]), None, None, rng.choice(["x\ny", "", None, "plain", "\n" * 50])) for i in range(60)]
    rows += [(None, "a", "en", 1, "t"), (None, "a", "en", 1, "t"), (None, None, None, None, None), (7, "hot", "en", 3, "dup"), (7, "hot", "en", 3, "dup"), (8, "long", "de", 10**6, "ab\n" * 300_000)]
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_sizes(spark, n):
    check(spark, [(i, "s", "en", i, f"t\n{i}") for i in range(n)])


def test_many_sources_of_one_row(spark):
    check(spark, [(i, f"s{i}", "en", i, f"t\n{i}") for i in range(31)])


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.op13_merkle_manifest(spark, small).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, unbroken)
    assert any(not r.verified for r in got) and any(r.verified for r in got)
