"""The registered queries over the smallest tables, against brute force or the
libraries."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import queries
from tidemark.llm.common import vocabulary


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def library(name):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(vocabulary(name))
    out.no_truncation()
    out.no_padding()
    return out


def test_op1(spark, small, texts):
    lib, at = library("word_bpe_49k.json"), 0
    got = {r.doc_id: r for r in queries.op1_token_store(spark, small).collect()}
    assert set(got) == set(texts)
    for k in sorted(texts):
        ids = np.array([*lib.encode(texts[k], add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op2(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows = [(k, np.array(v, float)) for k, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids, x = np.array([k for k, _ in rows]), np.stack([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got, hit, total = collections.defaultdict(list), 0, 0
    for r in sorted(queries.op2_kmeans_tree_search(spark, small).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    assert set(got) == {k for k in ids.tolist() if k % 50 == 0}
    for k, mine in got.items():
        s = u @ u[ids == k][0]
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(r.vec_id != k for r in mine)
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in mine)
        best = sorted((-round(v, 12), i) for v, i in zip(s.tolist(), ids.tolist(), strict=True) if i != k)[:5]
        hit += len({i for _, i in best} & {r.vec_id for r in mine})
        total += 5
    assert hit / total >= 0.9


def test_op4(spark, small, texts):
    lib, by, seen = library("byte_bpe_50k.json"), collections.defaultdict(list), set()
    ids = {k: np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    for r in queries.op4_best_fit_packing(spark, small).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 1024 and zlib.crc32(part.tobytes()) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
        seen.add((r.doc_id, r.piece, r.start, r.length))
    want = set()
    for k, a in ids.items():
        head = len(a) % 1024 or min(1024, len(a))
        cuts = [0, head, *range(head + 1024, len(a) + 1, 1024)]
        want |= {(k, i, s, e - s) for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert seen == want
    for s in by.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(by) <= -(-sum(n for s in by.values() for _, n in s) // 1024) + 2


def test_op6(spark, small, texts):
    """Lines that go are near an earlier line by the rules; lines that stay are
    near none."""
    from tests.llm.test_edges import distance

    got = {r.doc_id: r for r in queries.op6_line_dedup(spark, small).collect()}
    seen, by_length = set(), collections.defaultdict(list)
    for k in sorted(texts):
        kept = []
        for line in texts[k].split("\n"):
            w = tuple(line.strip(" \t\n\x0b\x0c\r").lower().split())
            if not w:
                kept.append(line)
                continue
            units = w if len(w) >= 8 else tuple(" ".join(w)) if len(" ".join(w)) >= 16 else None
            kind = len(w) >= 8
            near = w in seen or units is not None and any(
                sum((collections.Counter(units) - collections.Counter(v)).values()) <= 1 and distance(units, v) <= 1 for n in (-1, 0, 1) for v in by_length[kind, len(units) + n]
            )
            if not near:
                kept.append(line)
            if w not in seen:
                seen.add(w)
                if units is not None:
                    by_length[kind, len(units)].append(units)
        assert (got[k].text or "") == "\n".join(kept), k


def test_op7(spark, small, texts):
    got = {r.doc_id: r for r in queries.op7_weighted_fingerprints(spark, small).collect()}
    keys = sorted(texts, reverse=True)
    assert set(got) == set(keys)
    prints = collections.defaultdict(set)
    for k, after in zip(keys, keys[1:] + keys[:1], strict=True):
        t, n = texts[k], len(texts[k]) // 3
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256((t[: len(t) - n] + texts[after][:n]).encode()).hexdigest()
        same = [got[k].fingerprint[i : i + 6] == got[after].fingerprint[i : i + 6] for i in range(0, 192, 6)]
        assert got[k].near_next == pytest.approx(np.mean(same))
        prints[t].add(got[k].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_op8(spark, small, texts):
    from tidemark.llm.token_counts import _model

    sp = _model(vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, small).collect()}
    assert got == {k: (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for k, t in texts.items()}


def test_op9(spark, small, texts):
    lib = library("word_bpe_49k.json")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_forced_boundary_bpe(spark, small).collect()}
    for k, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[k] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode()))


def test_op10(spark, small):
    talks = collections.defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        talks[r.conv_id].append((r.turn, r.role, r.text or ""))
    talks[-1] = [(i, role, "<|im_end|><|im_start|>assistant ok") for i, role in enumerate(("user", "assistant"))]
    got = {r.conv_id: r for r in queries.op10_chat_windows(spark, small).collect()}
    assert set(got) == set(talks)
    for k, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k].formatted_chars >= len(whole)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, small)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
