"""Block-max search against brute force over all documents."""

import collections
import glob
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import queries, search
from tidemark.llm.common import arrow_rows, drop

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, block long, score long, terms string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    counted = [(k, collections.Counter(terms(t))) for k, t in docs]
    counted = [(k, c) for k, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for ident, text in items:
        own, asked = [], set(terms(text))
        for k, c in counted:
            m = 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                own.append((-s, k is None, k or 0, k))
        out += [(ident, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(own, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def made(seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the"] * 150 + ["Über", "ÉTÉ", "x1", "İ", "漢字", "naïve"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(k, "The hot copy of w1, w2; w3!") for k in range(500, 640)]
    docs += [(900, None), (901, ""), (902, " ...\n\t{}"), (903, "the " * 200_000 + "w5"), (904, "z" * 3_000_000), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 w9"), (7, "w1 w9")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere at-all"), (3, "w1 W1 w2"), (3, "w1 W1 w2"), (None, "über été"), (60, "the"), (61, "z" * 3_000_000), (62, "the hot copy")]
    return docs, items


def run(spark, docs, items, parts=5, **more):
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], SCHEMA).repartition(parts)
    q = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, rank long, query long")
    return sorted(map(tuple, search.ranked_search(d, q, **more).collect()), key=str)


@pytest.mark.parametrize(("per_block", "matrix"), [(128, 1 << 22), (3, 400)])
def test_against_brute_force(spark, monkeypatch, per_block, matrix):
    monkeypatch.setattr(search, "MATRIX", matrix)
    docs, items = made()
    assert run(spark, docs, items, per_block=per_block) == plain(docs, items)


def test_few_documents_and_none(spark):
    docs, items = [(1, "a b"), (2, "b c"), (3, None)], [(0, "a"), (1, "c b a"), (2, "d")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, top=1) == plain(docs, items, top=1)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, "..")], items) == []


def test_terms_in_runs():
    text = "Über, don't x-1 é" * 500 + "y" * 5_000
    for step in (1, 2, 3, 7, 64, 1 << 20):
        got = [t.decode() for part in search.terms_of(text.encode(), step) for t in part]
        assert got == terms(text), step


def test_blocks_below_the_threshold_are_left_out():
    """Of blocks about other things none is scored once the threshold is known."""
    best = search.Best(np.zeros(1), top=2)
    chunk = search._Chunk(0)
    chunk.add(1, {b"a", b"b"})
    chunk.weigh(100, np.array([1, 50]))
    for k in range(10):
        block = search._Block(100, 1000)
        for i in range(4):
            block.add(10 * k + i, b"a b" if k == 0 else b"b c")
        row = block.row(k)
        best.block(row, *search._bounds(row, chunk), chunk.weights)
    assert (best.scored, best.skipped) == (1, 9) and sorted(-x[2] for x in best.held[0]) == [0, 1]


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op11_block_max_search(spark, small).collect()), key=str) == plain(docs, items)


def test_a_reader_of_the_index_holds_few_blocks(spark):
    """Of 40 blocks of a MB each a row group has no more than fit, and a worker gets few at a time."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(50_000))) for i in range(40)], "doc_id long, text string").coalesce(1)
    index, n = search.build_index(docs, per_block=1)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{index._staged_path.removeprefix('file:')}/*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert n == sum(g.num_rows for g in groups) == 40 and max(g.total_byte_size for g in groups) < 12 << 20
    with arrow_rows(spark, search.AT_ONCE):
        sizes = [r.n for r in index.select("block").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 8
    drop(index)
