"""Each operator on nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names, against brute force or the libraries."""

import collections
import hashlib
import heapq
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann_tree, bpe, chat, components, fingerprints, langid, line_dedup, ngram_join, packing, token_counts, token_store
from tidemark.llm.common import new_path, vocabulary

rng = random.Random(3)
WORDS = [f"w{i}" for i in range(60)] + ["Über", "naïve", "İstanbul", "漢字", "🎉", "don't", "x" * 40]
LONG = " ".join(rng.choice(WORDS) for _ in range(30_000))
BASE = " ".join(rng.choice(WORDS) for _ in range(80))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " tail"), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one two"), (9, "ONE two"), (10, LONG), (11, LONG + " end"), (12, "a<|endoftext|>b </s> <|im_end|>"),
    (13, "!!! ??? ..."), (14, "\x00 nul \\ back"), (1, BASE), (None, "no key here at all"), (None, None), (15, "line one of the text here is long\nshort\nline one of the text here is lung\n\nshort"), (16, "é ﬁ Ⅳ ٣ ½ ΣΊΣ"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with the operators' own
    rows = [(i, t, "k", 7, i, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long, ord long, lang_pred string").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def order(rows):
    return sorted(rows, key=str)


def key_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_op1_round_trip_and_starts(spark, docs, none):
    path = new_path(spark, "t")
    token_store.write_store(docs, path)
    lib = library("word_bpe_49k.json")
    got = token_store.read_store(spark, path).collect()
    ids = lambda t: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert order((r.key, bytes(r.ids), r.ids_crc32) for r in got) == order((i, ids(t), zlib.crc32(ids(t))) for i, t in TEXTS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [k for k, _ in key_order((r.key, 0) for r in got)] == [r.key for r in sorted(got, key=lambda r: r.start)]
    store = spark.read.parquet(f"{path}/store")
    digests = [d for r in store.collect() for d in token_store.apart(bytes(r.digests))]
    kept = sum(len(r.digests) // 16 - len(r.refs) for r in store.collect())
    assert kept == len(set(digests)) < len(digests)  # each chunk once
    manifest = {r.shard: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    assert manifest[-1].n_docs == len(TEXTS) and manifest[-1].n_tokens == at

    empty = new_path(spark, "t")
    token_store.write_store(none, empty)
    assert token_store.read_store(spark, empty).count() == 0


def test_op1_damage_is_noticed(spark, docs):
    path, broken = new_path(spark, "t"), new_path(spark, "t")
    token_store.write_store(docs.filter("doc_id = 10"), path)
    spark.read.parquet(f"{path}/store").withColumn("payload", F.expr("overlay(payload PLACING X'FFFF' FROM 9)")).write.parquet(f"{broken}/store")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{broken}/manifest")
    with pytest.raises(Exception, match="differs from its digest"):
        token_store.read_store(spark, broken).collect()


def test_op1_lost_and_replaced_rows_are_noticed(spark, docs):
    path = new_path(spark, "t")
    token_store.write_store(docs, path)
    store = spark.read.parquet(f"{path}/store")
    last = store.filter("key = 16").select("shard", "nth").first()
    other = store.filter("key = 7").select("lens", "digests", "payload", "root", "n_tokens").first()
    changes = {
        "lost": store.filter(~((F.col("shard") == last.shard) & (F.col("nth") == last.nth))),
        "a shard lost": store.filter(F.col("shard") != last.shard),
        # a whole document in another's place: its own digests and root agree
        "replaced": store.select(*[F.when(F.col("key") == 8, F.lit(other[c])).otherwise(F.col(c)).alias(c) if c in other.__fields__ else F.col(c) for c in store.columns]),
    }
    for rows in changes.values():
        broken = new_path(spark, "t")
        rows.write.parquet(f"{broken}/store")
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{broken}/manifest")
        with pytest.raises(ValueError, match="differ from the manifest"):
            token_store.read_store(spark, broken)


def test_op1_tree_of_several_levels(spark):
    rows = [(s, i, f"{i * 7:x}") for s, n in ((1, 1), (2, 4), (3, 5), (4, 70)) for i in range(n)]
    df = spark.createDataFrame(rows, "shard int, nth long, root string").repartition(3)

    def root(level):
        if len(level) == 0:
            return None
        for _ in range(4):  # 70 leaves need four levels of four, and all trees have as many
            level = [hashlib.sha256("|".join(f"{i}:{x}" for i, x in list(enumerate(level))[s : s + 4]).encode()).hexdigest() for s in range(0, len(level), 4)]
        return level[0]

    got = {r.shard: r.root for r in token_store.tree_roots(df, "shard", fan=4).collect()}
    assert got == {s: root([x for t, _, x in rows if t == s]) for s in (1, 2, 3, 4)}
    assert token_store.tree_roots(df.filter("false"), "shard").count() == 0


def test_op1_encoder_on_random_strings():
    lib, enc = library("word_bpe_49k.json"), token_store.encoder(vocabulary("word_bpe_49k.json"))
    g, letters = random.Random(1), "abc XYZ'sdt019!?_-éßÑ\n\t<|>…\u0301Σİ漢😀 \x00\x85\xa0\x0b\x0c\x1c\x1f\u2003\u3000\u212a\u212bŸẞſ"
    for _ in range(3000):
        t = "".join(g.choice(letters) for _ in range(g.randrange(30)))
        assert enc.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_token_store_encodes_a_word_once_whatever_marks_it_has():
    class Counting:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, word):
            self.asked.append(word)
            return self.model.tokenize(word)

    lib, enc = library("word_bpe_49k.json"), token_store.Encoder(vocabulary("word_bpe_49k.json"))
    enc.model = Counting(enc.model)
    text = "thandsti thandsti, (thandsti) thandsti's èlleên ..èlleên.. don't 'tis ''s'' a'll'd 12a_b-3 __"
    assert enc.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert enc.model.asked.count("thandsti") == 1 and len(enc.model.asked) == len(set(enc.model.asked))


def test_op1_chunks_move_with_their_text():
    ids = np.random.default_rng(0).integers(0, 49000, 20_000).astype("<u2")
    ends = token_store.boundaries(ids)
    moved = token_store.boundaries(np.concatenate([np.arange(5, dtype="<u2"), ids]))
    assert ends[-1] == len(ids) and len(set(np.array(moved) - 5) & set(ends)) > 0.8 * len(ends)
    assert max(np.diff([0, *ends])) <= 4096


def test_op2_against_brute_force(spark):
    g = np.random.default_rng(0)
    centres = g.normal(size=(12, 16)) * 4
    x = (centres[g.integers(0, 12, 900)] + g.normal(size=(900, 16))).astype(np.float32)
    x[400:460] = x[400]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] * 16), (2200, [float("inf")] * 16), (2250, [1.0] * 3), (2300, [None] * 16), (400, x[400].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann_tree.nearest(df, F.col("vec_id") % 50 == 0, leaf=40, sample=400).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = total = 0
    for q in range(0, 900, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert len(mine) >= 5 and all(r.vec_id != q for r in mine)
        s = np.round(u @ u[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(900), -s))[:5]
        hit += len(set(best.tolist()) & {r.vec_id for r in mine})
        total += 5
        assert all(abs(r.score - float(u[r.vec_id] @ u[q])) < 1e-12 for r in mine)
    assert hit / total >= 0.9
    assert {r.query_id for r in got} == set(range(0, 900, 50))
    assert ann_tree.nearest(df.filter("false"), F.lit(True)).count() == 0
    two = df.filter("vec_id IN (1, 2)")
    assert [(r.query_id, r.vec_id) for r in ann_tree.nearest(two, F.col("vec_id") == 1).collect()] == [(1, 2)]


def test_op2_reach_orders_leaves_best_bin_first():
    g = np.random.default_rng(3)
    x, q = (ann_tree._unit(g.normal(size=(n, 5))) for n in (600, 20))
    tree = ann_tree.grow(x, branch=4, leaf=6)
    leaves = tree.leaves()
    assert set(tree.descend(x).tolist()) == set(leaves.tolist()) and len(leaves) > 100
    for row, reach in zip(q, ann_tree.Tree.reach(q, tree.paths(leaves)), strict=True):
        heap, out = [(0.0, 0)], []
        while heap:  # branches by their centre's nearness
            _, node = heapq.heappop(heap)
            if not tree.n[node]:
                out.append(node)
            for kid in range(tree.first[node], tree.first[node] + tree.n[node]):
                heapq.heappush(heap, (-float(tree.centres[kid] @ row), kid))
        got = reach[np.searchsorted(leaves, out)]
        assert len(out) == len(leaves) and (np.diff(got) <= 1e-12).all()
    some = leaves[5:40]
    assert np.allclose(ann_tree.Tree.reach(q, tree.paths(some)), ann_tree.Tree.reach(q, tree.paths(leaves))[:, 5:40])


def test_op2_tiles_hold_whole_leaves_or_parts_of_one():
    first, many = ann_tree._tiles(np.arange(7), np.array([3, 4, 0, 25, 2, 9, 8]), most=10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5, 6] and many.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_op2_compares_visited_leaves_only_and_settles_ties():
    g = np.random.default_rng(5)
    x = g.normal(size=(300, 4)).astype("<f4")
    x[100:140] = x[100] * np.float32(2) ** np.arange(40)[:, None]  # equal cosines of other vectors
    tree = ann_tree.grow(ann_tree._unit(x.astype(float)), branch=4, leaf=20)
    leaf, e, q = tree.descend(ann_tree._unit(x.astype(float))), np.arange(300) + 7, x[95:105]
    for least in (np.full(10, -np.inf), np.linspace(-0.5, 0.9, 10)):
        reach = ann_tree.Tree.reach(ann_tree._unit(q.astype(float)), tree.paths(leaf))
        got = sorted(tuple(r) for part in ann_tree.compare(q, least, x, leaf, e, -e, tree, 6, step=16) for r in zip(*(c.tolist() for c in part), strict=True))
        want = []
        for i in range(10):
            s = ann_tree.cosines(q[i].astype(float), x.astype(float))
            rows = sorted(((-s[j], -e[j], e[j]) for j in range(300) if reach[i, j] >= least[i]))[:6]
            want += [(i, -a, c, b) for a, b, c in rows]
        assert got == sorted(want)


def test_op2_driver_holds_no_list_of_leaves_for_each_probe(spark):
    """12,000 rows in thousands of leaves, 240 queries."""
    x = np.random.default_rng(1).normal(size=(12_000, 3))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(12_000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    tracemalloc.start()
    try:
        out = ann_tree.nearest(df, F.col("vec_id") % 50 == 0, leaf=4)
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert most < 64, most
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = {(r.query_id, r.vec_id) for r in out.collect()}
    want = {(q, j) for q in range(0, 12_000, 50) for j in np.argsort(-np.where(np.arange(12_000) == q, -9, u @ u[q]))[:5].tolist()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def brute_components(rows, n, num):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= num * (len(sets[i]) + len(sets[j]) - o):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (k, _) in enumerate(rows):
        ks = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(ks, default=None) if sets[i] else k))
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
def test_op3_against_brute_force(spark, docs, none, n, num):
    got = ngram_join.link_components(docs, n=n, num=num).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(brute_components(TEXTS, n, num))
    assert ngram_join.link_components(none, n=n, num=num).count() == 0


@pytest.mark.parametrize("num", [80, 90])
def test_op3_near_copies_around_a_shared_text(spark, num):
    """A group in which most pairs do not link but chains do."""
    g = random.Random(num)
    base = [f"t{g.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for _ in range(g.randrange(1, 6)):
            w[g.randrange(len(w))] = f"n{g.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{g.randrange(10**6)}" for _ in range(40)) + " " + " ".join(base[:50])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = ngram_join.link_components(df, n=3, num=num).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(brute_components(rows, 3, num))


def test_op3_prefixes_and_parts_lose_no_pair():
    g = np.random.default_rng(1)
    for num in (80, 90):
        t = ngram_join.Threshold(num, 100)
        for _ in range(300):
            n = int(g.integers(1, 200)) if g.random() < 0.8 else int(g.integers(900, 1200))
            x = np.unique(g.integers(0, 2**62, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[g.random(len(x)) > 0.05], g.integers(0, 2**62, int(g.integers(0, 1 + n // 10))).astype(np.uint64)]))
            if len(y) and t.enough(len(np.intersect1d(x, y)), len(x), len(y)):
                met = len(np.intersect1d(x[: t.prefix(len(x))], y[: t.prefix(len(y))]))
                assert met >= max(t.spare(t.least(len(x))), t.spare(t.least(len(y))))
                parts = [{int(h) for tile, k in t.tiles(len(s)) for h in ngram_join.part_hashes(s, tile, k)} for s in (x, y)]
                assert parts[0] & parts[1]  # no link is lost
                maps = [ngram_join.parity_bitmap(s) for s in (x, y)]
                bits = ngram_join.fold(maps, min(map(len, maps)))
                assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("n", [150, 190, 400])
def test_op3_unrelated_sets_do_not_meet(n):
    g, t = np.random.default_rng(n), ngram_join.Threshold(80, 100)
    held = collections.Counter()
    for _ in range(2000):
        s = np.unique(g.integers(0, 2**62, n).astype(np.uint64))
        held.update({int(h) for tile, k in t.tiles(len(s)) for h in ngram_join.part_hashes(s, tile, k)})
    assert sum(c * (c - 1) // 2 for c in held.values()) < 0.001 * 2000 * 1999 / 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


def test_op4_against_the_library(spark, docs, none):
    lib, got = library("byte_bpe_50k.json"), packing.pack(docs, ids=True).collect()
    want = []
    for i, t in TEXTS:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        head = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, head, *range(head + 1024, len(ids) + 1, 1024)]
        want += [(i, n, s, e - s, zlib.crc32(ids[s:e].tobytes())) for n, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == order(want)
    by = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_op4_ids_on_random_strings_and_at_the_bound():
    lib, ids = library("byte_bpe_50k.json"), packing.ids_of(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    g, letters = random.Random(4), "ab cdXYZ'sdtrevmll019!?_-éßÑ\n\n\t<|>…\u0301Σİ漢😀 \x00\x85\xa0\r "
    texts = ["".join(g.choice(letters) for _ in range(g.randrange(60))) for _ in range(3000)] + [" " * 5000, "a<|endoftext|> b", "\n" * 3000]
    texts += [("the quick brown fox " * 10_000)[: packing.LONG + d] for d in (-1, 0, 1)]
    for t in texts:
        assert ids.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_op4_bin_completion():
    assert packing.spans(1024, 1024) == [(0, 1024)] and packing.spans(1030, 1024) == [(0, 6), (6, 1024)] and packing.spans(1, 1024) == [(0, 1)]
    assert packing._dominates(((6, 1),), ((3, 2),)) and not packing._dominates(((3, 2),), ((6, 1),))
    assert not packing._dominates(((5, 2),), ((4, 1), (3, 2)))
    size = lambda plan: sum(m for _, m in plan)
    # the search alone: best fit puts the fives together and needs a third bin
    counts = {5: 2, 4: 2, 3: 2}
    assert (size(packing.best_fit(counts, 12)), size(packing.plan_bins(counts, 12, exchanges=False))) == (3, 2)
    g, better = random.Random(0), 0
    for _ in range(30):
        counts = collections.Counter(g.randrange(1, 101) for _ in range(g.randrange(1, 200)))
        plan = packing.plan_bins(counts, 100)
        used = collections.Counter()
        for pattern, times in plan:
            assert sum(x * c for x, c in pattern) <= 100
            for x, c in pattern:
                used[x] += c * times
        assert used == counts and packing.lower_bound(counts, 100) <= size(plan) <= size(packing.best_fit(counts, 100))
    for _ in range(150):  # against all packings of few items
        counts = collections.Counter(g.randrange(2, 17) for _ in range(g.randrange(4, 10)))
        found, fit = size(packing.plan_bins(counts, 20, exchanges=False)), size(packing.best_fit(counts, 20))
        assert found == fewest(sorted(counts.elements(), reverse=True), 20)
        better += found < fit
    assert better


def fewest(items, capacity, rooms=()):
    if not items:
        return len(rooms)
    new = fewest(items[1:], capacity, (*rooms, capacity - items[0]))
    return min([new, *(fewest(items[1:], capacity, (*rooms[:i], r - items[0], *rooms[i + 1 :])) for i, r in enumerate(rooms) if r >= items[0])])


def test_op4_fillings_are_full_and_undominated():
    g = random.Random(1)
    for _ in range(200):
        counts, room = collections.Counter(g.randrange(1, 30) for _ in range(g.randrange(1, 9))), g.randrange(1, 60)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums if s + x <= room}
        found = packing.completions(room, counts)
        assert sum(x * c for x, c in found[0]) == max(sums) and all(c <= counts[x] for f in found for x, c in f)
        assert not any(packing._dominates(a, b) for i, a in enumerate(found) for b in found[i + 1 :])


def test_op5_accuracy_and_special_texts(spark):
    tongue = {"aa": "kala tuna mira soto".split(), "bb": "sch ung lich zwer pfau".split(), "cc": "éclair où ça forêt".split()}
    g = random.Random(2)
    rows = [(i, " ".join(g.choice(tongue[lang]) + g.choice(tongue[lang]) for _ in range(30)), lang) for i in range(150) for lang in [list(tongue)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (1003, "SCHUNG LICHZWER UNGPFAU", None), (1004, "kala " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = langid.is_held_out()
    got = {r.doc_id: r for r in langid.identify(df, learn=~held, keep=["doc_id", "lang", "score"]).collect()}
    assert len(got) == len(rows)
    test = [got[i] for i, _, lang in rows if lang and i < 1000 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert test and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and got[1004].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string")), keep=["doc_id"]).collect()} == {"und"}
    # letters of the highest planes are letters; unlearned scripts have few known n-grams
    more = spark.createDataFrame([(None, "\U000323af \U00031350"), (None, "Москва столица"), (2000, "\u02b0")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    rows = langid.identify(df.select("doc_id", "text", "lang").unionByName(more), learn=~F.coalesce(held, F.lit(False)), keep=["doc_id", "text"]).collect()
    odd = [r for r in rows if r.doc_id in (None, 2000)]
    assert len(odd) == 3 and all(r.lang_pred != "und" and r.known < 0.5 for r in odd)
    assert all(r.known > 0.5 for r in rows if r.doc_id is not None and r.doc_id < 1000)
    assert langid.identify(df.filter("false")).count() == 0


def test_op5_against_a_dense_ridge_solution(spark):
    """The folded matrix and the summed normal equations against kernels of
    sets, and the runs of a text against all of it at once."""
    g = random.Random(5)
    rows = [(i, " ".join("".join(g.choice("abcde" if i % 2 else "cdefg") for _ in range(g.randrange(1, 7))) for _ in range(20)), "xy"[i % 2]) for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string").repartition(3), landmarks=20)
    sample = sorted(langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 400).collect(), key=lambda r: (r.l, r.h))
    assert len(sample) == 60
    flags = [set(np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r.b), np.uint8), count=langid.SIZE)).tolist()) for r in sample]
    marks = [f for lang in "xy" for f in [f for f, r in zip(flags, sample, strict=True) if r.l == lang][:10]]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    w, v = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    half = v / np.sqrt(w)
    phi = np.array([[kernel(a, b) for b in marks] for a in flags]) @ half
    target = np.array([[1.0, -1.0] if r.l == "x" else [-1.0, 1.0] for r in sample])
    beta = np.linalg.solve(phi.T @ phi + 1e-3 * 60 * np.eye(20), phi.T @ target)
    for _, t, _ in rows[:10]:
        f = set(np.concatenate(langid.grams(t)).tolist())
        assert f == set(np.concatenate(langid.grams(t, run=7)).tolist())
        want = np.array([kernel(f, m) for m in marks]) @ half @ beta
        flag = np.zeros(langid.SIZE, np.float32)
        flag[list(f)] = 1
        assert flag @ model.weights[:, :-2] / np.sqrt(len(f)) == pytest.approx(want, abs=1e-4)


def test_op5_query(spark, small):
    from tidemark.llm.queries import op5_string_kernel_language

    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op5_string_kernel_language(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    test = [r for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert test and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in test) / len(test) > 0.97


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def test_op6_typos_in_short_lines(spark):
    g = random.Random(8)
    seeds = ["all rights reserved here", "Read more of this story", "é 日本語のテキストです、これは長い行", "a b c", "one two three four five six seven", "abcdefghijklmnop"]
    lines = [" ".join("abcdefghijklmnop")]  # as words, not the characters of the last seed
    for _ in range(150):
        x = g.choice(seeds)
        for _ in range(g.randrange(3)):
            p = g.randrange(len(x))
            x = g.choice([x[:p] + x[p + 1 :], x[:p] + g.choice("xyz") + x[p:], x[:p] + g.choice("xyz") + x[p + 1 :]])
        lines.append(x)
    seen, want = [], []
    for line in lines:
        w = line.lower().split()
        x, few = " ".join(w), len(w) < 8
        if not any(x == y or few and len(v) < 8 and len(x) >= 16 <= len(y) and distance(x, y) <= 1 for v, y in seen):
            want.append(line)
        seen.append((w, x))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = [r.text for r in line_dedup.dedup_lines(df).orderBy("doc_id").collect()]
    assert got == want and len(want) < len({" ".join(x.lower().split()) for x in lines})


def test_op6_against_pairs_of_lines(spark, docs, none):
    g = random.Random(4)
    lines = [" ".join(g.choice("abcdef") for _ in range(n)) for n in (9, 9, 10, 12, 3, 8)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(4):
            w = g.choice(lines).split()
            for _ in range(g.randrange(3)):
                p = g.randrange(len(w))
                w = g.choice([w[:p] + w[p + 1 :], w[:p] + [g.choice("xyz")] + w[p:], w[:p] + [g.choice("xyz")] + w[p + 1 :]])
            own.append(g.choice(["", " ", "\t"]) + " ".join(w))
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1])]
    seen, want = [], {}
    for k, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            w = line.lower().split()
            old = any(w == v or len(w) >= 8 and len(v) >= 8 and distance(w, v) <= 1 for v in seen)
            if w:
                seen.append(w)
            if not w or not old:
                kept.append(line)
        want[k] = None if t is None else "\n".join(kept)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, keep_empty=True).collect()}
    assert got == want
    assert {r.doc_id for r in line_dedup.dedup_lines(df).collect()} == {k for k, t in want.items() if k != 103 and (t == rows[k][1] if k < 100 else True) or (t or "").strip()}
    all_rows = line_dedup.dedup_lines(docs, keep_empty=True).collect()
    assert len(all_rows) == len(TEXTS) and line_dedup.dedup_lines(none).count() == 0
    assert next(r.text for r in all_rows if r.doc_id == 15) == "line one of the text here is long\nshort\n"


def test_op6_very_long_lines_and_repeated_keys(spark):
    # lines of more words than a sum of hashes could take, and one of a single long word
    big = " ".join(str(i % 977) for i in range(600_000))
    blob = "ab1c" * 300_000
    rows = [(1, big), (2, big.replace(" 976 ", " x ", 1)), (3, big + " y z"), (4, blob), (5, blob[:-1])]
    # one key with different texts: each is a document of its own
    rows += [(9, "first text of the key, of many words"), (9, "second text of the key, of some words"), (None, "a line without a key at all here"), (None, "a line without a key at all hers"), (10, "second text of the key, of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = order((r.doc_id, hashlib.md5(r.text.encode()).hexdigest()) for r in line_dedup.dedup_lines(df).collect())
    # a null key comes first; of its two near lines the one whose text has the smaller digest stays
    null = min(rows[7:9], key=lambda r: hashlib.md5(r[1].encode()).digest())
    want = order((k, hashlib.md5(t.encode()).hexdigest()) for k, t in [rows[0], rows[2], rows[3], rows[5], rows[6], null])
    assert got == want


def test_op7_equal_texts_and_likeness(spark, docs, none):
    got = fingerprints.neighbours(docs, samples=16).collect()
    assert len(got) == len(TEXTS)
    # descending keys, nulls last; of equal keys larger text hash first: only distinct keys are checked here
    seq = sorted(((i, t or "") for i, t in TEXTS if i not in (None, 1)), reverse=True)
    rows = {r.doc_id: r for r in got}
    for (i, t), (_, nxt) in zip(seq, seq[1:], strict=False):
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].near_next == pytest.approx(np.mean([a == b for a, b in zip(re.findall("......", rows[i].fingerprint), re.findall("......", fp(got, nxt)), strict=True)]))
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs, samples=16).collect()}
    assert plain[1] == plain[2] == rows[1].fingerprint and plain[4] == plain[5] == plain[6] != plain[7]
    assert fingerprints.neighbours(none).count() == 0
    one = fingerprints.neighbours(docs.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1


@pytest.mark.parametrize("ranges", [1, 8, 40])
def test_op7_hot_keys_and_ends_of_the_key_range(spark, ranges):
    """A key of most rows is spread; order, and so the next text, stays whole."""
    rows = [(5, f"text number {i} of the hot key") for i in range(60)] + [(i, f"other {i}") for i in (-(1 << 63), 1, 2, 4, 6, 9, (1 << 63) - 1)] + [(None, "no key"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    seq = sorted(((k is not None, k or 0, hashed[t or ""], t or "", k) for k, t in rows), reverse=True)
    want = []
    for (*_, t, k), (*_, nxt, _) in zip(seq, seq[1:] + seq[:1], strict=True):
        n = len(t) // 3
        want.append((k, hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    got = fingerprints.neighbours(df, samples=4, ranges=ranges).collect()
    assert order((r.doc_id, r.edited_sha256) for r in got) == order(want)


def fp(rows, text):
    return next(r.fingerprint for r in rows for i, t in TEXTS if r.doc_id == i and (t or "") == text and r.n_chars == len(text))


def test_op7_estimates_generalised_jaccard(spark):
    g = random.Random(0)
    make = lambda: [g.choice(WORDS[:50]) for _ in range(200)]
    err = []
    rows, pairs = [], []
    for i in range(40):
        a = make()
        b = a[: 40 + 4 * i] + make()[: 160 - 4 * i]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = collections.Counter(a), collections.Counter(b)
        pairs.append(sum((x & y).values()) / sum((x | y).values()))
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), samples=64).collect()}
    for i, want in enumerate(pairs):
        a, b = (re.findall("......", got[k]) for k in (2 * i, 2 * i + 1))
        err.append(np.mean([p == q for p, q in zip(a, b, strict=True)]) - want)
    assert abs(np.mean(err)) < 0.05 and np.std(err) < 0.12


@pytest.mark.parametrize(("most", "salts"), [(8 << 20, None), (50, 3)])
def test_op8_against_the_library(spark, docs, none, most, salts):
    sp = token_counts._model(vocabulary("piece_bpe_32k.model"))
    got = token_counts.count_tokens(docs, most=most, salts=salts).collect()
    assert order((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == order((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in TEXTS)
    assert token_counts.count_tokens(none).count() == 0


def test_op8_repeated_keys_and_hot_pre_tokens(spark):
    sp = token_counts._model(vocabulary("piece_bpe_32k.model"))
    # the first two texts share a 32-bit hash
    texts = ["t 219095", "t 366350 and some more words here", "-" * 300 + " rule", "", None, "x"] + ["-" * 300 + f" rule {i}" for i in range(40)]
    rows = [(None, t) for t in texts] + [(1 << 60, t) for t in texts]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), salts=5, most=600).collect()
    assert order((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == order((k, len(t or ""), len(sp.encode(t or ""))) for k, t in rows)


def test_op8_cuts_on_random_strings():
    sp = token_counts._model(vocabulary("piece_bpe_32k.model"))
    g, letters = random.Random(8), "ab  \u2581\n\n\t.é漢😀Σ\u0301\x00-<|>s"
    for _ in range(3000):
        t = "".join(g.choice(letters) for _ in range(g.randrange(40)))
        f = token_counts.frequencies(t)
        assert f == token_counts.frequencies(t, run=3)
        n = token_counts.piece_counts(sp, list(f))
        assert sum(a * b for a, b in zip(n, f.values(), strict=True)) == len(sp.encode(t)), repr(t)


def test_op9_against_the_library(spark, docs, none):
    lib = library("word_bpe_49k.json")
    got = bpe.encode_decode(docs).collect()
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    assert order((r.doc_id, bytes(r.ids), r.decoded) for r in got) == order((i, np.array(ids(t), "<u4").tobytes(), lib.decode(ids(t), skip_special_tokens=False)) for i, t in TEXTS)
    assert bpe.encode_decode(none).count() == 0


def test_op9_random_strings():
    lib, mine = library("word_bpe_49k.json"), bpe.FragmentBpe(vocabulary("word_bpe_49k.json"))
    g, letters = random.Random(9), "abc XYZ'sdtrevml019!?_-éßÑ\n\t<|>…́Σİ漢😀 \x00\x85\xa0"
    for _ in range(1500):
        t = "".join(g.choice(letters) for _ in range(g.randrange(40)))
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    for word in ("qzx" * 400, "é漢" * 200, "q", "漢"):
        letters = "".join(mine.letters[b] for b in word.encode())
        assert mine.word(letters) == lib.encode(word, add_special_tokens=False).ids
    # byte pairs that no token holds are there, and cut
    assert mine.cuts("".join(mine.letters[b] for b in "é漢".encode()))
    ids = np.array([1, 60_000, 2, 49_407], "<u4")
    assert mine.decode(ids.tobytes()) == lib.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize(("budget", "history"), [(2048, 512), (200, 60), (40, 16)])
def test_op10_reads_back(spark, budget, history):
    g, bits = random.Random(budget), ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<\\|", "hello ", "\n", "%0A", "é", "<", "|>"]
    rows = []
    for c in [*range(25), None]:
        for n in range(g.randrange(1, 30)):
            rows.append((c, g.choice([n, n, None]), g.choice(["user", "assistant", "system", "a\nb<%", None]), g.choice([None, "", "".join(g.choice(bits) for _ in range(g.randrange(30)))])))
    rows += rows[:3] + [(500, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(5)
    windows = chat.format_windows(df, budget, history)
    got = {r.conv_id: r for r in chat.digest(windows).collect()}
    talks = collections.defaultdict(list)
    for c, n, role, text in rows:
        talks[c].append((n is not None, n or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns = [(r, t) for *_, r, _, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        spent = [line for line in w.formatted.split("<|im_end|>\n")[:-1]]
        assert len(spent) == len(w.turns) and all(line.startswith("<|im_start|>") and "<|" not in line[12:] for line in spent)
        assert all("<|im_" not in w.formatted[s.at : s.at + s.chars] for s in w.loss)
    assert chat.format_windows(df.filter("false")).count() == 0


def test_op10_repeats_history_within_its_allowance(spark):
    rows = [(1, 0, "system", "rule")] + [(1, i, ["assistant", "user"][i % 2], "x" * 80) for i in range(1, 40)]
    got = sorted(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, 60).collect(), key=lambda w: w.window)
    assert len(got) > 5
    for w in got:
        assert w.turns[0].ord == 0 and len(w.formatted) < 4 * 260
    assert any(not t.fresh for t in got[3].turns[1:]) and sum(t.fresh for w in got for t in w.turns) == 40


@pytest.mark.parametrize(("budget", "history", "given"), [(300, 80, False), (120, 40, False), (200, 40, True)])
def test_op10_windows_keep_their_budget(spark, budget, history, given):
    g, rows = random.Random(budget), []
    for c in range(30):
        for n in range(g.randrange(1, 60)):
            role = "system" if n == 0 and c % 3 == 0 else ["user", "assistant"][n % 2]
            rows.append((c, n, role, " ".join(g.choice(WORDS) for _ in range(g.randrange(0, 12 if g.random() < 0.9 else 120))), g.randrange(1, 40)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost long").repartition(3)
    # told from the text, or real counts of a vocabulary
    if given:
        counts = token_counts.count_tokens(df.select(F.struct("conv_id", "turn").cast("string").alias("doc_id"), "text")).select("doc_id", (F.col("n_tokens") + 4).alias("cost"))
        df = df.drop("cost").withColumn("doc_id", F.struct("conv_id", "turn").cast("string")).join(counts, "doc_id")
    cost = F.col("cost") if given else chat.turn_tokens(F.col("text"))
    own = {(r.conv_id, r.turn): r.n for r in df.select("conv_id", "turn", cost.alias("n")).collect()}
    seen = collections.Counter()
    for w in chat.format_windows(df, budget, history, "cost" if given else None).collect():
        n = [own[w.conv_id, t.ord] for t in w.turns]
        fresh = [t.ord for t in w.turns if t.fresh and not (t.ord == 0 and w.conv_id % 3 == 0)]
        system = own[w.conv_id, 0] if w.conv_id % 3 == 0 else 0
        assert sum(n) <= budget or len(fresh) == 1 and len(n) <= 2 and own[w.conv_id, fresh[0]] > budget - system or budget - system < 32
        seen.update((w.conv_id, o) for o in fresh)
    assert max(seen.values()) == 1 and len(seen) == sum(not (r[1] == 0 and r[0] % 3 == 0) for r in rows)
    # windows are those of a plain walk: as many new turns as fit beside what is repeated
    got = collections.defaultdict(list)
    for w in chat.format_windows(df, budget, history, "cost" if given else None).collect():
        got[w.conv_id].append(([t.ord for t in w.turns if not t.fresh and (t.ord or w.conv_id % 3)], [t.ord for t in w.turns if t.fresh and (t.ord or w.conv_id % 3)]))
    for c in range(30):
        first = c % 3 == 0
        room = max(32, budget - (own[c, 0] if first else 0))
        turns = [(o, max(1, n)) for (k, o), n in sorted(own.items()) if k == c and (o or not first)]
        want, at = [], 0
        while at < len(turns):
            old, allow = at, min(history, max(0, room - turns[at][1]))
            while old and sum(n for _, n in turns[old - 1 : at]) <= allow:
                old -= 1
            end = at + 1
            while end < len(turns) and sum(n for _, n in turns[old : end + 1]) <= room:
                end += 1
            want.append(([o for o, _ in turns[old:at]], [o for o, _ in turns[at:end]]))
            at = end
        assert sorted(got[c], key=lambda w: w[1]) == (want or [([], [])]), c


@pytest.mark.parametrize("salts", [3, 12, 16, 64])
@pytest.mark.parametrize("batches", [1, 3, 16])
def test_op8_hot_pre_tokens_are_spread(salts, batches):
    """Whatever the tasks and batches, at least half of the groups are used, and none
    gets far more than its share."""
    groups = collections.Counter(token_counts.salt_of(task, n, salts) for task in range(4 * salts) for n in range(1, batches + 1))
    assert len(groups) >= salts / 2 and max(groups.values()) <= 4 * batches * 4


@pytest.mark.parametrize("hot", [5, None])
def test_op1_a_hot_key_is_spread(spark, hot):
    """Nine tenths of the rows have one key (or none); no shard gets much more than its share."""
    schema = "doc_id long, text string"
    rows = [(hot, f"text {i} of the hot key " + "word " * (i % 7)) for i in range(900)] + [(i, f"other text {i}") for i in range(100)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        path = new_path(spark, "hot-key")
        token_store.write_store(spark.createDataFrame(rows, schema).repartition(6), path)
        sizes = [r["count"] for r in spark.read.parquet(f"{path}/store").groupBy("shard").count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * 1000 / 8
        got = token_store.read_store(spark, path, ids=False).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    at = 0
    for r in got:  # ascending keys, nulls first, and nothing between
        assert r.start == at
        at += r.n_tokens
    keys = [r.key for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(keys) == 1000
