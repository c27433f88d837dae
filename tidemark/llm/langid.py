"""Language identification with string kernels.

A text's features are which character n-grams of one to three symbols it holds
(blended spectrum, presence only), over a reduced alphabet: letters of any case
fold to classes, everything else is a gap.  The kernel of two texts is the
number of n-grams they share over the geometric mean of their numbers.  The
Nystroem method represents a text by its kernels with ``landmarks`` labelled
texts; one-versus-rest kernel ridge regression on that representation gives a
score per language.  Batches are scored by matrix products: presences times
landmark presences times coefficients (the last two folded into one matrix).

The fit takes at most ``per_language`` distinct labelled texts of each language:
those of which key and text hash lowest, a uniform sample that no hot source,
key, copy or row order can bias.  A first pass estimates how many distinct ones
there are, and only rows under the hash bound that follows travel, so no task
takes a whole language.  Only the landmarks, as n-gram bitmaps of fixed size,
come to the driver; the normal equations of the regression are summed up on the
executors, and their size depends on the landmarks alone.  Every row is
predicted, from its whole text, read in runs of fixed length.

Null text, or text without a letter: language ``und``, score
0, known 0.  A
table without any labelled text: ``und`` for all.  Rows with null keys are
learned from and predicted like others; rows repeated in key and text count once
in the sample and are predicted alike; other columns are ignored, and columns
named like the results are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, stage

#: Symbols: 0 gap, 1-26 a-z, the rest shares of all other letters by code point.
SYMBOLS = 48
SIZE = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
UNKNOWN = "und"


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """Symbol of each code point.  Letters beyond a-z fold to lower case and
    share the remaining symbols."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()[0] if c < 0x3000 else ch  # of the blocks above, what counts is that they are letters
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SYMBOLS - 27)
    return table


def grams(text: str, run: int = 1 << 18) -> list[np.ndarray]:
    """Codes of the n-grams of a text, repeats included, in runs of its
    characters; none without letters.  Gaps collapse to one, and n-grams do not
    reach across two."""
    out: list[np.ndarray] = []
    tail, letters = np.zeros(1, np.int32), False
    for at in range(0, len(text), run):
        s = alphabet()[np.frombuffer(text[at : at + run].encode("utf-32-le", "replace"), np.uint32)]
        letters = letters or bool(s.any())
        end = [0] if at + run >= len(text) else []
        s = np.concatenate([tail, s, end]).astype(np.int32)
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        two = s[:-1] * SYMBOLS + s[1:]
        out += [s, two + SYMBOLS, two[:-1] * SYMBOLS + s[2:] + SYMBOLS + SYMBOLS**2]
        tail = s[-2:]  # what the next run's first n-grams begin with
    return out if letters else []


def presence(text: str) -> np.ndarray:
    flags = np.zeros(SIZE, bool)
    for g in grams(text):
        flags[g] = True
    return flags


@dataclass
class Model:
    """``weights``: n-gram by language, the product of landmark presences and
    regression coefficients, then whether any landmark has it, then ones.  There is no intercept: a text
    that shares nothing with the landmarks scores 0 for each language."""

    languages: list[str]
    weights: np.ndarray

    def score(self, texts: list[str | None], batch: int = 64) -> list[tuple[str, float, float]]:
        """Language, share of a softmax over the one-versus-rest scores, and the
        share of n-grams that some landmark has."""
        out: list[tuple[str, float, float]] = []
        flags = np.zeros((batch, SIZE), np.float32)
        for at in range(0, len(texts), batch):
            part, codes = texts[at : at + batch], []
            for i, t in enumerate(part):
                g = grams(t) if t else []
                for x in g:
                    flags[i, x] = 1
                codes.append(g)
            sums = flags[: len(part)] @ self.weights
            sizes = sums[:, -1]  # the last column counts the text's n-grams
            for i, g in enumerate(codes):
                for x in g:
                    flags[i, x] = 0
                if not g or not self.languages:
                    out.append((UNKNOWN, 0.0, 0.0))
                    continue
                margin = sums[i, :-2] / np.sqrt(float(sizes[i]))
                p = np.exp(4 * (margin - margin.max()))
                best = int(np.argmax(margin))
                out.append((self.languages[best], float(p[best] / p.sum()), float(sums[i, -2] / sizes[i])))
        return out


class Landmarks:
    """Presences of the landmarks, on the n-grams that any of them has, and the
    map from kernels with them to the representation."""

    def __init__(self, bitmaps: list[bytes]):
        flags = np.unpackbits(np.frombuffer(b"".join(bitmaps), np.uint8).reshape(len(bitmaps), -1), axis=1, count=SIZE)
        self.used = np.flatnonzero(flags.any(0))
        self.marks = flags[:, self.used].astype(np.float32)
        del flags
        self.marks /= np.sqrt(np.maximum(self.marks.sum(1, keepdims=True), 1))
        w, v = np.linalg.eigh((self.marks @ self.marks.T).astype(np.float64))
        keep = w > 1e-8 * w.max()
        self.half = v[:, keep] / np.sqrt(w[keep])

    def represent(self, bitmaps: list[bytes]) -> np.ndarray:
        flags = np.unpackbits(np.frombuffer(b"".join(bitmaps), np.uint8).reshape(len(bitmaps), -1), axis=1, count=SIZE)
        x = flags[:, self.used].astype(np.float32) / np.sqrt(np.maximum(flags.sum(1, keepdims=True, dtype=np.int64), 1)).astype(np.float32)
        return (x @ self.marks.T).astype(np.float64) @ self.half


def solve(marks: Landmarks, languages: list[str], gram: np.ndarray, cross: np.ndarray, n: int, ridge: float) -> Model:
    beta = np.linalg.solve(gram + ridge * n * np.eye(len(gram)), cross)
    weights = np.zeros((SIZE, len(languages) + 2), np.float32)
    weights[marks.used, :-2] = marks.marks.T @ (marks.half @ beta)
    weights[marks.used, -2] = 1
    weights[:, -1] = 1
    return Model(languages, weights)


def sample(docs: DataFrame, key: str, text: str, label: str, per_language: int) -> DataFrame:
    """Labels, hashes and bitmaps of the bounded sample, staged: l, h, b."""

    def bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flags = [presence(t) for t in pdf["t"]]
            rows = [(lang, h, np.packbits(f).tobytes()) for lang, h, f in zip(pdf["l"], pdf["h"], flags, strict=True) if f.any()]
            yield pd.DataFrame(rows, columns=["l", "h", "b"])

    # a hash of key and text: neither a hot key nor a group of copies weighs more than one row
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("l"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)).alias("h"),
        F.col(text).alias("t")
    )
    sizes = rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    # twice the share that is wanted: what the estimate and texts without letters may take off
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n"))
    bounds = sizes.select("l", F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long")).alias("bound"))
    low = rows.join(F.broadcast(bounds), "l").filter(F.col("h") <= F.col("bound"))  # a row per language
    found = low.groupBy("l", "h").agg(F.min("t").alias("t"))
    made = stage(found.mapInPandas(bitmaps, "l string, h long, b binary"), "language-sample", rows_at_once=256)
    # the hash of the last row that counts, per language: some 2 * per_language numbers of each
    last = made.groupBy("l").agg(F.sort_array(F.collect_list("h")).alias("hs")).select(
        "l", F.expr(f"hs[least(size(hs), {int(per_language)}) - 1]").alias("last")
    )
    out = stage(made.join(F.broadcast(last), "l").filter(F.col("h") <= F.col("last")).drop("last"), "language-sample")
    drop(made)
    return out


def fit(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 400, landmarks: int = 256, ridge: float = 1e-3
) -> Model:
    """The classifier of the labelled rows of ``docs``."""
    spark = docs.sparkSession
    rows = sample(docs, key, text, label, per_language)
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row per language
    languages = sorted(counts)
    if not languages:
        drop(rows)
        return Model([], np.zeros((SIZE, 2), np.float32))
    # landmarks: as many of each language as there are
    each = max(1, landmarks // len(languages))
    cut = rows.groupBy("l").agg(F.sort_array(F.collect_list("h")).alias("hs")).select("l", F.expr(f"hs[least(size(hs), {each}) - 1]").alias("last"))
    chosen = rows.join(F.broadcast(cut), "l").filter(F.col("h") <= F.col("last")).select("l", "h", "b").collect()
    marks = Landmarks([bytes(r["b"]) for r in sorted(chosen, key=lambda r: (r["l"], r["h"]))])
    del chosen
    shared = spark.sparkContext.broadcast(marks)
    n, column = sum(counts.values()), {lang: i for i, lang in enumerate(languages)}
    # languages weigh alike, whatever their shares
    weight = {lang: n / (len(languages) * c) for lang, c in counts.items()}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The normal equations' sums over a task's rows."""
        gram = cross = 0.0
        for pdf in batches:
            if len(pdf):
                phi = shared.value.represent([bytes(b) for b in pdf["b"]])
                target = np.full((len(pdf), len(languages)), -1.0)
                target[np.arange(len(pdf)), [column[x] for x in pdf["l"]]] = 1
                weighted = phi * np.array([weight[x] for x in pdf["l"]])[:, None]
                gram, cross = gram + weighted.T @ phi, cross + weighted.T @ target
        if np.ndim(gram):
            yield pd.DataFrame({"gram": [gram.tobytes()], "cross": [cross.tobytes()]})

    # few tasks: the sample is bounded, and each returns one matrix of landmarks by landmarks
    parts = stage(
        rows.select("l", "b").repartitionById(4, F.pmod("h", F.lit(4)).cast("int")).mapInPandas(sums, "gram binary, cross binary"), "language-sums",
        rows_at_once=64
    )
    got, size = parts.collect(), marks.half.shape[1]
    gram = sum(np.frombuffer(bytes(r["gram"])) for r in got).reshape(size, size)
    cross = sum(np.frombuffer(bytes(r["cross"])) for r in got).reshape(size, -1)
    shared.destroy()
    drop(rows, parts)
    return solve(marks, languages, gram, cross, n, ridge)


def identify(
    docs: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 400,
    landmarks: int = 256, keep: list[str] | None = None
) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``known`` (0 to 1: the share of
    the text's n-grams that some landmark has; texts of languages and scripts
    that were not learned, and random letters, have few) to ``keep`` columns (all
    of them, if not given).  ``learn``: condition for rows that may be learned from."""
    model = fit(docs if learn is None else docs.filter(learn), key, text, label, per_language, landmarks)
    names = keep if keep is not None else docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))
    del model

    @F.pandas_udf("lang_pred string, score double, known double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame(m.score([t if isinstance(t, str) else None for t in texts]), columns=["lang_pred", "score", "known"])

    # only texts go to Python and only scores come back; a filter on the result must not run it twice
    out = ("lang_pred", "score", "known")
    scored = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], predict.asNondeterministic()(F.col(text)).alias("_p"))
    return scored.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c not in out], *[F.col(f"_p.{c}").alias(c) for c in out])


def is_held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 3 == 1
