"""Ranked lexical search with block-max pruning.

1. *Statistics.*  One pass counts documents and terms, which a term's impact in a
   document depends on.
2. *Index.*  Ranges of documents, in the table's own order, are blocks: their
   distinct terms with the largest impact of each and the number of documents that
   hold it, and forward postings (document, impact) by term.  A table with one row
   per block, of a MB or more: what bounds need is read without the postings, and
   row groups of a few blocks are all that a reader holds, however large its share
   of the table.
3. *Bounds.*  A query's weights times a block's maxima bound every score in it from
   above.  Each task sorts its blocks by them; the best few of all give a first
   threshold, the score of the ``top``-th document there.
4. *Scores.*  Then all blocks are gone through, those of a group in the order of
   their bounds; a block is scored for the queries whose bound reaches their
   threshold (that of step 3 or of what the task itself has found, whichever is
   higher), and left out for the others.  Nothing that could be among the best is
   left out: a bound equal to the threshold is scored.

Scores are sums of products of whole numbers below 2^53, so that products of double
matrices are exact.  Queries go through in chunks whose matrix (terms x queries) is
bounded; chunks are all that comes to the driver.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII;
only A-Z are lower-cased.  Null, empty and blank texts have none, as documents and
as queries, and are never found.  Repeated documents are found as often as they are
there, ties go to the smaller id, null ids come last; repeated or null queries are
queries of their own.  Texts of any length are counted whole.  Empty tables give no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, drop, stage

#: Letters A-Z become small; what is no term becomes a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = "block long, docs array<long>, terms binary, tops binary, dfs binary, starts binary, places binary, impacts binary"
#: Numbers in a chunk's matrix of weights.
MATRIX = 1 << 22
#: Blocks that a Python worker gets at a time, and MB after which a row group of the index ends.
AT_ONCE, GROUP_MB = 8, 8


def terms_of(text: bytes | None, run: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, in runs of some ``run`` bytes."""
    text, at = text or b"", 0
    while at < len(text):
        part = text[at : at + run].translate(TABLE)
        if at + run < len(text):  # up to the last term's end
            cut = part.rfind(b" ")
            while cut < 0:
                more = text[at + len(part) : at + len(part) + run].translate(TABLE)
                if not more:
                    break
                gap = more.find(b" ")
                part += more if gap < 0 else more[: gap + 1]
                cut = -1 if gap < 0 else len(part) - 1
            part = part[: cut + 1] if cut >= 0 else part
        yield part.split()
        at += len(part)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[int, int]:
    """The number of documents that have a term, and of terms with repeats."""

    def count(batches):
        n = total = 0
        for b in batches:
            for t in b.column(1):
                own = sum(map(len, terms_of(t.as_py())))
                n, total = n + (own > 0), total + own
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    sums = stage(_texts(docs, key, text).mapInArrow(count, "n long, total long"), "search-statistics", rows_at_once=500)
    row = sums.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    drop(sums)
    return row["n"] or 0, row["total"] or 0


class _Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Block:
    """A range of documents being indexed."""

    def __init__(self, n: int, total: int):
        self.n, self.total = n, total
        self.terms, self.docs, self.size = _Numbers(), [], 0
        self.codes, self.tfs, self.lengths, self.distinct = [], [], [], []

    def add(self, key: int | None, text: bytes) -> None:
        counts: Counter = Counter()
        for run in terms_of(text):
            counts.update(run)
        if not counts:
            return
        number = self.terms
        self.codes.append(np.array([number[t] for t in counts], np.int32))
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.docs.append(key)
        self.lengths.append(counts.total())
        self.distinct.append(len(counts))
        self.size += len(text)

    def row(self, block: int) -> dict:
        code, tf = np.concatenate(self.codes), np.concatenate(self.tfs)
        place = np.repeat(np.arange(len(self.docs), dtype=np.int32), self.distinct)
        # lengths against the mean, in whole numbers of any size
        m = np.array([100 - 50 + (50 * x * self.n) // self.total for x in self.lengths], np.int64)
        impact = ((1_000_000_000 * tf) // (1000 * tf + 20 * m[place])).astype(np.int32)
        by = np.argsort(code, kind="stable")
        code, place, impact = code[by], place[by], impact[by]
        starts = np.searchsorted(code, np.arange(len(self.terms) + 1)).astype(np.int32)
        return {
            "block": block, "docs": self.docs, "terms": b" ".join(self.terms), "tops": np.maximum.reduceat(impact, starts[:-1]).tobytes(),
            "dfs": np.diff(starts).astype(np.int32).tobytes(), "starts": starts.tobytes(), "places": place.tobytes(), "impacts": impact.tobytes()
        }


_ARROW = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("terms", "tops", "dfs", "starts", "places", "impacts")]])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", per_block: int = 128, most: int = 1 << 21, path: str | None = None) -> tuple[DataFrame, int]:
    """(index, number of documents with a term).  Blocks end at ``per_block``
    documents or ``most`` bytes of text."""
    n, total = statistics(docs, key, text)

    def index(batches):
        at = TaskContext.get().partitionId() << 33
        own = _Block(n, total)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own.add(k, t.as_py() or b"")
                if len(own.docs) >= per_block or own.size >= most:
                    yield pa.RecordBatch.from_pylist([own.row(at)], _ARROW)
                    at, own = at + 1, _Block(n, total)
        if own.docs:
            yield pa.RecordBatch.from_pylist([own.row(at)], _ARROW)

    return stage(_texts(docs, key, text).mapInArrow(index, BLOCK), "search-index", path, rows_at_once=500, group_mb=GROUP_MB), n


class _Chunk:
    """Queries that go through together: their ids, terms and, once the numbers of
    documents are known, weights."""

    def __init__(self, first: int):
        self.first, self.ids, self.own, self.terms = first, [], [], _Numbers()

    def add(self, ident, terms: set[bytes]) -> None:
        self.ids.append(ident)
        self.own.append([self.terms[t] for t in sorted(terms)])

    def weigh(self, n: int, dfs: np.ndarray) -> None:
        """Weights by term and query; terms in no document weigh nothing."""
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) if f else 0 for f in dfs], np.float64)
        self.weights = np.zeros((len(self.terms), len(self.ids)))
        for q, own in enumerate(self.own):
            self.weights[own, q] = w[own]


def _chunks(queries: DataFrame, ident: str, text: str) -> Iterator[_Chunk]:
    now = _Chunk(0)
    for i, t in _texts(queries, ident, text).toLocalIterator():
        terms = {x for run in terms_of(bytes(t) if t is not None else None) for x in run}
        if now.ids and (len(now.terms) + len(terms)) * (len(now.ids) + 1) > MATRIX:
            yield now
            now = _Chunk(now.first + len(now.ids))
        now.add(i, terms)
    if now.ids:
        yield now


def _known(terms: bytes, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places among a block's terms, and among the queries', of those they share."""
    got = [(i, v) for i, t in enumerate(terms.split(b" ")) if (v := vocabulary.get(t)) is not None]
    return np.array([i for i, _ in got], np.int64), np.array([v for _, v in got], np.int64)


class Best:
    """The best ``top`` documents of each query so far, and its threshold."""

    def __init__(self, floors: np.ndarray, top: int):
        self.floors, self.top, self.scored, self.skipped = floors.copy(), top, 0, 0
        self.held: dict[int, list[tuple]] = {}

    def add(self, q: int, scores: np.ndarray, docs: list[int | None]) -> None:
        held = self.held.setdefault(q, [])
        for i in np.flatnonzero((scores > 0) & (scores >= self.floors[q])).tolist():
            # greater is better: score, then an id over none, then the smaller id
            item = (int(scores[i]), docs[i] is not None, -(docs[i] or 0))
            if len(held) < self.top:
                heapq.heappush(held, item)
            elif item > held[0]:
                heapq.heapreplace(held, item)
        if len(held) == self.top:
            self.floors[q] = max(self.floors[q], held[0][0])

    def block(self, row: dict, at: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, weights: np.ndarray, only: np.ndarray | None = None) -> None:
        """Score a block for the queries whose bound reaches their threshold."""
        asked = np.flatnonzero((bounds > 0) & (bounds >= self.floors))
        asked = asked if only is None else np.intersect1d(asked, only)
        self.scored, self.skipped = self.scored + len(asked), self.skipped + int((bounds > 0).sum()) - len(asked)
        if not len(asked):
            return
        mine, theirs = at
        starts, places, impacts = (np.frombuffer(row[c], np.int32) for c in ("starts", "places", "impacts"))
        scores, step = np.zeros((len(row["docs"]), len(asked))), max(1, MATRIX // len(row["docs"]))
        for k in range(0, len(mine), step):  # some terms at a time, so that the matrix stays small
            some = mine[k : k + step]
            sizes = starts[some + 1] - starts[some]
            posting = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            part = np.zeros((len(row["docs"]), len(some)))
            part[places[posting], np.repeat(np.arange(len(some)), sizes)] = impacts[posting]
            scores += part @ weights[np.ix_(theirs[k : k + step], asked)]
        best = scores.max(axis=0)
        for j in np.flatnonzero((best > 0) & (best >= self.floors[asked])).tolist():
            self.add(int(asked[j]), scores[:, j], row["docs"])

    def rows(self, chunk: _Chunk) -> pa.RecordBatch:
        got = [(chunk.first + q, chunk.ids[q], -d if some else None, s) for q, held in self.held.items() for s, some, d in held]
        columns = list(zip(*got, strict=True)) if got else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "item_id", "doc_id", "score"])


def _bounds(row: dict, chunk: _Chunk) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    at = _known(row["terms"], chunk.terms)
    return at, np.frombuffer(row["tops"], np.int32)[at[0]].astype(np.float64) @ chunk.weights[at[1]]


def _document_counts(index: DataFrame, chunk: _Chunk) -> np.ndarray:
    def count(batches):
        total = np.zeros(len(chunk.terms), np.int64)
        for b in batches:
            for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine, theirs = _known(t, chunk.terms)
                total[theirs] += np.frombuffer(d, np.int32)[mine]
        yield pa.RecordBatch.from_pydict({"term": np.flatnonzero(total), "df": total[np.flatnonzero(total)]})

    out = np.zeros(len(chunk.terms), np.int64)
    with arrow_rows(index.sparkSession, AT_ONCE):
        for term, df in index.select("terms", "dfs").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
            out[term] = df
    return out


def _first_blocks(index: DataFrame, chunk: _Chunk, each: int) -> dict[int, list[int]]:
    """The blocks of the largest bounds of each query: block to queries."""

    def find(batches):
        held: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for row in b.to_pylist():
                bounds = _bounds(row, chunk)[1]
                for q in np.flatnonzero(bounds).tolist():
                    own = held.setdefault(q, [])
                    (heapq.heappush if len(own) < each else heapq.heappushpop)(own, (bounds[q], row["block"]))
        got = [(q, block, bound) for q, own in held.items() for bound, block in own]
        yield pa.RecordBatch.from_pydict({"q": pa.array([x[0] for x in got], pa.int64()), "block": pa.array([x[1] for x in got], pa.int64()), "bound": pa.array([x[2] for x in got], pa.float64())})

    rows = index.select("block", "terms", "tops").mapInArrow(find, "q long, block long, bound double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    out: dict[int, list[int]] = {}
    with arrow_rows(index.sparkSession, AT_ONCE):
        for q, block in rows.withColumn("r", rank).filter(F.col("r") <= each).select("q", "block").collect():
            out.setdefault(block, []).append(q)
    return out


def _scored(index: DataFrame, chunk: _Chunk, floors: np.ndarray, top: int, only: dict[int, list[int]] | None = None, group: int = 32 << 20) -> DataFrame:
    """The best documents that each task finds, staged: query, item_id, doc_id, score."""

    def score(batches):
        best, held, size = Best(floors, top), [], 0

        def work():
            held.sort(key=lambda x: -x[2].max(initial=0))
            for row, at, bounds in held:
                best.block(row, at, bounds, chunk.weights, None if only is None else np.array(only[row["block"]]))

        for b in batches:
            for row in b.to_pylist():
                held.append((row, *_bounds(row, chunk)))
                size += sum(len(x) for x in row.values() if isinstance(x, bytes))
                if size >= group:
                    work()
                    held, size = [], 0
        work()
        yield best.rows(chunk)

    blocks = index if only is None else index.filter(F.col("block").isin(list(only)))
    return stage(blocks.mapInArrow(score, "query long, item_id long, doc_id long, score long"), "search-scored", rows_at_once=AT_ONCE)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: DataFrame, n: int, queries: DataFrame, ident: str = "item_id", text: str = "text", top: int = 50, first: int = 4) -> DataFrame:
    """The ``top`` best documents of each query: item_id, rank, doc_id, score."""
    spark: SparkSession = index.sparkSession
    found = spark.createDataFrame([], "query long, item_id long, doc_id long, score long")
    for chunk in _chunks(queries, ident, text):
        chunk.weigh(n, _document_counts(index, chunk))
        floors, blocks = np.zeros(len(chunk.ids)), _first_blocks(index, chunk, first)
        if blocks:
            sample = _scored(index, chunk, floors, top, blocks)
            for q, s in _ranked(sample, top).filter(F.col("rank") == top).select("query", "score").collect():
                floors[q - chunk.first] = s
            drop(sample)
            found = found.unionByName(_scored(index, chunk, floors, top))
    return _ranked(found, top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = 50, key: str = "doc_id", text: str = "text", ident: str = "item_id", per_block: int = 128) -> DataFrame:
    """Index ``docs``, search for each of ``queries``, drop the index; staged."""
    index, n = build_index(docs, key, text, per_block)
    out = stage(search(index, n, queries, ident, text, top), "search-results")
    drop(index)
    return out
