"""Token counts without ids: pieces are counted once per distinct pre-token.

No piece of the vocabulary has a blank after another character, and none has a
line feed, so text falls apart into pre-tokens (blanks and the characters that
follow them; line feeds) whose counts add up.

1. *Frequencies.*  Each text is split once.  A batch of documents (``most`` bytes
   of text, or one document) gives one row for each of its distinct pre-tokens,
   with the batch's documents that hold it and how often each does.
2. *Counts.*  Rows meet by pre-token: the library counts the pieces of each
   distinct one, once, and every document's frequency is multiplied by them.
   Pre-tokens that several documents of a batch share are the hot ones, and are
   dealt over ``salts`` groups (each counts them again).
3. *Sums.*  Products are added up by document before and after they return to
   their batch, where it is checked that every frequency was answered.

Null or empty text has no tokens.  Null and repeated keys, and repeated rows,
give one row each: documents are known by batch and place, never by key or by a
hash of their text.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage, vocabulary

#: Blanks (U+2581 is how the library writes a blank) with what follows; line
#: feeds; anything else that follows a line feed.
PRE_TOKEN = re.compile("[ ▁]+[^ ▁\\n]*|\\n+|[^ ▁\\n]+")
#: Where a new pre-token begins.
_BEGIN = re.compile("(?<=[^ ▁]) |(?<=[^ ▁\\n])\\n")
PAIR = np.dtype([("doc", "<i4"), ("times", "<i4")])
REPLY = np.dtype([("doc", "<i4"), ("answered", "<i4"), ("pieces", "<i8")])


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_vocabulary(path: str) -> None:
    """Whether the cuts above are safe for this model; an error if not."""
    model = _model(path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {piece!r} crosses a pre-token boundary")


def frequencies(text: str, run: int = 1 << 20) -> Counter:
    """How often a text has each pre-token, split in runs of characters.  The
    library puts a blank before any text that is not empty."""
    found: Counter = Counter()
    text, at = " " + text if text else "", 0
    while at < len(text):
        cut = _BEGIN.search(text, at + run) if len(text) > at + run else None
        end = cut.start() if cut else len(text)
        found.update(PRE_TOKEN.findall(text[at:end]))
        at = end
    return found


def piece_counts(model, pre_tokens: list[str]) -> list[int]:
    """The library's number of pieces of each pre-token within a text."""
    # the library adds one blank in front: drop ours, or shield what follows a line feed
    asked = [p[1:] if p[0] in " ▁" else "\n" + p for p in pre_tokens]
    n = [len(x) for x in model.encode(asked, num_threads=1)]
    # a pre-token of nothing but that blank: the library makes no piece of empty text
    return [1 if a == "" else x if p[0] in " ▁" else x - 2 for p, a, x in zip(pre_tokens, asked, n, strict=True)]


def salt_of(task: int, number: int, salts: int) -> int:
    """The group of a batch's hot pre-tokens, by a hash of task and number: batches
    are spread over all groups whatever their tasks and however many each has."""
    x = (task * 0x9E3779B97F4A7C15 + number * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ x >> 31) * 0x94D049BB133111EB) & (2**64 - 1)
    return (x ^ x >> 29) % salts


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``data`` that end at ``ends`` as a column of binaries."""
    offsets = np.concatenate([[0], ends * data.dtype.itemsize]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _records(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a column of binaries, and how many each row has."""
    rows = [b or b"" for b in column.to_pylist()]
    return np.frombuffer(b"".join(rows), dtype), np.array([len(b) // dtype.itemsize for b in rows], np.int64)


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096, most: int = 32 << 20,
    salts: int | None = None
) -> DataFrame:
    """Per row: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``salts``: groups of a hot pre-token, a sixteenth of the shuffle partitions
    if not given."""
    check_vocabulary(vocabulary(model))
    spark = docs.sparkSession
    kt = docs.schema[key].dataType.simpleString()
    salts = salts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    columns = "p string, salt int, batch long, pairs binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for got in batches:
            texts, at = got.column("t"), 0
            while at < len(texts):
                number += 1
                batch = (task << 33) + number
                group = salt_of(task, number, salts)
                ids: dict[str, int] = {}
                codes, docs_, times, sizes = [], [], [], []
                while at + len(sizes) < len(texts) and sum(sizes) < most:
                    t = texts[at + len(sizes)].as_py() or ""
                    sizes.append(len(t.encode()))
                    f = frequencies(t)
                    codes.append(np.fromiter((ids.setdefault(p, len(ids)) for p in f), np.int64, len(f)))
                    times.append(np.fromiter(f.values(), np.int64, len(f)))
                    docs_.append(np.full(len(f), len(sizes) - 1))
                code = np.concatenate(codes)
                order = np.argsort(code, kind="stable")
                pairs = np.empty(len(code), PAIR)
                pairs["doc"], pairs["times"] = np.concatenate(docs_)[order], np.concatenate(times)[order]
                held = np.bincount(code, minlength=len(ids))
                salt = np.where(held > 3, group, 0).astype(np.int32)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(ids), pa.string()), pa.array(salt), pa.array(np.full(n, batch)), _binaries(pairs, np.cumsum(held))], names
                )
                # the batch itself travels beside its pre-tokens: how many frequencies there are, keys and sizes, in one value
                # (Spark weighs each row of an Arrow batch, and lists make that take the square of their number)
                own = pa.RecordBatch.from_arrays([got.column("k").slice(at, len(sizes)), pa.array(sizes, pa.int64())], ["k", "n_bytes"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as stream:
                    stream.write_batch(own)
                packed_ = len(pairs).to_bytes(8, "little") + sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.string()), pa.array([number % (1 << 20)], pa.int32()), pa.array([batch]), pa.array([packed_])], names
                )
                at += len(sizes)

    names = ["p", "salt", "batch", "pairs"]
    packed = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(split, columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, last = _model(vocabulary(model)), (None, 0)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def replies() -> Iterator[pa.RecordBatch]:
            where, doc, pieces = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 3
            kept.clear()
            order = np.lexsort((doc, where))
            where, doc, pieces = where[order], doc[order], pieces[order]
            new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])])) if len(where) else np.zeros(0, np.int64)
            out = np.empty(len(new), REPLY)
            if not len(new):
                return
            out["doc"], out["pieces"] = doc[new], np.add.reduceat(pieces, new)
            out["answered"] = np.diff(np.append(new, len(where)))
            of = where[new]
            ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array([""] * n), pa.nulls(n, pa.int32()), pa.array(of[ends - 1]), _binaries(out, ends)], names)

        for got in batches:
            words = got.column("p").to_pylist()
            own = np.array([w is None for w in words], bool)
            if own.any():  # the batches' own rows pass through
                yield got.filter(pa.array(own))
                got = got.filter(pa.array(~own))
                words = [w for w in words if w is not None]
            if not words:
                continue
            distinct = list(dict.fromkeys(w for w in words if w != last[0]))
            n = dict([last]) | dict(zip(distinct, piece_counts(sp, distinct), strict=True))
            last = (words[-1], n[words[-1]])  # equal ones follow one another, also across frames
            pairs, lengths = _records(got.column("pairs"), PAIR)
            pieces = np.repeat(np.fromiter(map(n.__getitem__, words), np.int64, len(words)), lengths) * pairs["times"]
            kept.append((np.repeat(got.column("batch").to_numpy(), lengths), pairs["doc"].astype(np.int64), pieces))
            if sum(len(k[0]) for k in kept) > 1 << 21:
                yield from replies()
        if kept:
            yield from replies()

    counted = packed.repartition("p", "salt").sortWithinPartitions("p").mapInArrow(count, columns)

    def total(rows: pa.Table) -> pa.Table:
        own = pa.compute.is_null(rows.column("p"))
        info, answers = rows.filter(own).column("pairs").to_pylist(), rows.filter(pa.compute.invert(own))
        if len(info) != 1:
            raise ValueError(f"a batch came {len(info)} times: the input changed between attempts")
        facts = pa.ipc.open_stream(info[0][8:]).read_all()
        pieces, answered = np.zeros(facts.num_rows, np.int64), 0
        for raw in answers.column("pairs").to_pylist():
            r = np.frombuffer(raw, REPLY)
            pieces[r["doc"]] += r["pieces"]  # a document is once in each reply
            answered += int(r["answered"].sum())
        if answered != int.from_bytes(info[0][:8], "little"):
            raise ValueError("not every pre-token was answered: the input changed between attempts")
        return facts.append_column("n_tokens", pa.array(pieces))

    out = stage(counted.select("p", "batch", "pairs").groupBy("batch").applyInArrow(total, f"k {kt}, n_bytes long, n_tokens long"), "token-counts")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
