"""BPE encoding and decoding by forced-boundary splitting.

A merge can only ever join two neighbouring bytes that stand side by side
inside some vocabulary token.  A byte pair that occurs inside no token is
therefore a certain cut: the fragments between such cuts are encoded
independently and their ids concatenated, with the result of encoding the
whole.  Blank-delimited stretches and fragments repeat, so each distinct one is
encoded once per worker and looked up afterwards.

The vocabulary is a ``tokenizers`` JSON file with byte-level BPE and a word-end
suffix.  Normalisation and pre-tokenisation of plain Latin text are done here;
text with any other character goes through the library's own normaliser and
pre-tokeniser, so that both follow its Unicode tables exactly.

Results for special cases: null or empty text has no ids and decodes to the
empty string; special strings inside a text become their ids, as the library
does by default; ids unknown to the vocabulary are skipped in decoding.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import vocabulary

#: Characters whose case, normal form and class do not depend on the version of
#: Unicode tables: ASCII, the Latin-1 letters and common typographic marks.
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ¡¿«»–—‘’“”…€]")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Memo(dict):
    """A table of results by key, of bounded size: when it is full, its entries
    become the old generation, from which those still asked for come back.
    Results do not depend on the bound."""

    def __init__(self, compute, most: int = 300_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


class FragmentBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        suffix: str = spec["model"].get("end_of_word_suffix") or ""
        self.ending = self.library.model  # whose last byte ends a word
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.inner = BPE(vocab=vocab, merges=merges) if suffix else self.ending
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: tokens by id, for decoding many at a time
        self.tokens = np.full(1 + max([*vocab.values(), *self.special.values()]), None, object)
        for t, i in (vocab | self.special).items():
            self.tokens[i] = t
        #: pairs of byte letters that stand side by side in some token
        self.inside = {core[i : i + 2] for t in vocab for core in [t.removesuffix(suffix) if suffix else t] for i in range(len(core) - 1)}
        self.words = Memo(self._chunk, 500_000)
        self.fragments = Memo(lambda k: self.fragment(*k), 50_000)

    def fragment(self, fragment: str, last: bool) -> list[int]:
        """Ids of one fragment, as byte letters.  The vocabulary's own merges are
        applied by the library's model, with the word-end suffix or without."""
        return [t.id for t in (self.ending if last else self.inner).tokenize(fragment)]

    def cuts(self, word: str) -> list[int]:
        """Places of a word (as byte letters) that no token reaches across."""
        return [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside]

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token, given as byte letters."""
        cuts = self.cuts(word)
        if not cuts:
            return self.fragment(word, True)
        at = [0, *cuts, len(word)]
        out: list[int] = []
        for s, e in zip(at, at[1:], strict=False):
            out += self.fragments[word[s:e], e == len(word)] if e - s <= 64 else self.fragment(word[s:e], e == len(word))
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of lower-case text without white space."""
        ids: list[int] = []
        for w in (chunk,) if chunk.isalpha() else _WORD.findall(chunk):
            ids += self.word(w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode())))
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def _through_library(self, text: str) -> bytes:
        ids: list[int] = []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            ids += self.word(piece)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        return b"".join(
            np.array([self.special[p]], "<u4").tobytes()
            if p in self.special
            else b"" if not p
            else self._through_library(p) if _OTHER.search(p) else self._plain(p)
            for p in parts
        )

    def decode(self, ids: bytes) -> str:
        """Vocabularies of this kind name no decoder: tokens joined by spaces."""
        a = np.frombuffer(ids, "<u4")
        found = self.tokens[a if not len(a) or a.max() < len(self.tokens) else a[a < len(self.tokens)]].tolist()
        try:
            return " ".join(found)
        except TypeError:  # ids between the known ones
            return " ".join([t for t in found if t is not None])


@lru_cache(maxsize=4)
def fragment_bpe(path: str) -> FragmentBpe:
    return FragmentBpe(path)


def encode_decode(
    docs: DataFrame, text: str = "text", key: str = "doc_id", vocab: str = "word_bpe_49k.json", ids: bool = True, decoded: bool = True
) -> DataFrame:
    """Per row: ``key``, ``n_tokens``, ``ids`` (binary, little-endian unsigned
    32-bit), ``decoded`` and the SHA-256 of both.  ``ids=False`` and
    ``decoded=False`` leave the large columns out.

    Null or empty text: no tokens.  Repeated rows give repeated rows; other
    columns of ``docs`` are ignored, whatever their names."""
    spec = f"_key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = fragment_bpe(vocabulary(vocab))
        for pdf in batches:
            rows = []
            for t in pdf["_text"]:
                b = bpe.encode(t)
                d = bpe.decode(b)
                rows.append((
                    len(b) // 4, b if ids else None, hashlib.sha256(b).hexdigest(), d if decoded else None,
                    hashlib.sha256(d.encode("utf-8", "replace")).hexdigest()
                ))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"])
            out.insert(0, "_key", pdf["_key"].to_numpy())
            yield out

    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, spec)
    keep = ["n_tokens", *(["ids"] if ids else []), "ids_sha256", *(["decoded"] if decoded else []), "decoded_sha256"]
    return out.select(F.col("_key").alias(key), *keep)
