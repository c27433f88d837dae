"""A content-addressed store of token ids.

Writing: each text is encoded; a rolling sum over a window of mixed ids cuts the
id stream into chunks wherever its hash falls on a boundary value, so equal
passages give equal chunks wherever they stand.  A chunk is stored once, in the
row of the first document (in ``key`` order) that holds it.  A document's row
has its recipe (chunk digests in order, lengths, and for chunks kept elsewhere
the row that keeps them) and the Merkle root over its digests; the manifest has
a root over each shard's documents and one over the shards.

Layout under the path:
  ``store/``     Parquet, in ascending key order: shard, nth (place in the
                 shard), key, rid, start, n_tokens, lens (of the chunks,
                 little-endian 32-bit), digests (16 bytes each), refs and shared
                 (with ``uses``: how often the chunk occurs), payload, root.  The
                 payload holds the row's own chunks as little-endian ids of
                 ``width`` bytes.
  ``manifest/``  Parquet: shard (-1: the corpus), n_docs, n_tokens, root.

Reading first builds the trees over the stored roots again and compares them and
the counts with the manifest: a lost, added, moved or replaced row is an error.
It then resolves references with a join on the keeping row, hashes every chunk
again and compares digests and roots; a mismatch or a missing chunk is an error.
Only chunks that are shared travel through a shuffle on reading, a hot one once
for every thousand of its uses.

Null or empty text: a document of the end id alone.  Repeated keys and rows stay
separate rows (ordered by key, then by row number); null keys come first.
An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import _OTHER, _WORD, Memo, byte_letters
from tidemark.llm.common import drop, join_skewed, running_start, stage, vocabulary
from tidemark.plans.order import place_among


class Encoder:
    """Ids by the tokenizers library.  Where the vocabulary drops white space
    before splitting (it has a word-end suffix and a removing splitter), plain
    text is encoded one blank-delimited stretch at a time, each distinct word of
    them by the library's model once, with whatever marks it stands; otherwise
    the library encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_stretch = bool(spec["model"].get("end_of_word_suffix")) and steps[0].get("behavior") == "Removed"
        # special strings, and what Python alone takes for white space
        self.apart = [*(t["content"] for t in spec["added_tokens"]), "\x1c", "\x1d", "\x1e", "\x1f"]
        self.model, self.letters = self.library.model, byte_letters()
        self.known = Memo(self._stretch, 500_000)  # and as many of the generation before: a worker's memory, of whom an executor may have several
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.pack = struct.Struct(f"<{self.code}").pack

    def _stretch(self, stretch: str) -> bytes | None:
        """Ids of a stretch of lower-case text without white space, by the
        library's model; none if it isn't plain."""
        plain = stretch.isascii()
        if not plain and _OTHER.search(stretch) or plain and not stretch.isprintable():
            return None
        if not stretch.isalpha() and len(words := _WORD.findall(stretch)) > 1:
            return b"".join(map(self.known.__getitem__, words))  # each of them a stretch of its own, with the same ids
        ids = [t.id for t in self.model.tokenize(stretch if plain else "".join(map(self.letters.__getitem__, stretch.encode())))]
        return self.pack(*ids) if len(ids) == 1 else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, text: str | None) -> np.ndarray:
        if text and self.by_stretch and not any(s in text for s in self.apart):
            try:
                return np.frombuffer(b"".join(map(self.known.__getitem__, text.lower().split())), f"<u{self.width}")
            except TypeError:  # a stretch that isn't plain
                pass
        return np.array(self.library.encode(text or "", add_special_tokens=False).ids, f"<u{self.width}")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def boundaries(ids: np.ndarray, window: int = 16, bits: int = 9, least: int = 64, most: int = 4096) -> list[int]:
    """Ends of the chunks of an id stream: where the sum of ``window`` mixed ids
    hashes to a value whose ``bits`` high bits are zero, no sooner than ``least``
    ids after the last cut and no later than ``most``."""
    n = len(ids)
    ends, last = [], 0
    if n > least:
        mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        total = np.cumsum(mixed, dtype=np.uint32)
        rolling = total.copy()
        rolling[window:] -= total[:-window]
        rolling *= np.uint32(0x85EBCA6B)
        for c in (np.flatnonzero(rolling < np.uint32(1 << (32 - bits))) + 1).tolist():
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least and c < n:
                ends.append(c)
                last = c
    while n - last > most:
        last += most
        ends.append(last)
    return [*ends, n]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def apart(digests: bytes) -> list[bytes]:
    return [digests[i : i + 16] for i in range(0, len(digests), 16)]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs of digests hashed level by level; an odd one moves up as it is."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def tree_roots(leaves: DataFrame, by: str, fan: int = 256) -> DataFrame:
    """``leaves``: ``by``, nth (from 0, without gaps) and root (hex).  Per ``by``
    the root of a tree in which each node hashes up to ``fan`` below it: a step
    for each level, and no value holds more than ``fan`` roots."""
    levels, most = 1, leaves.agg(F.max("nth")).first()[0] or 0
    while most >= fan:
        levels, most = levels + 1, most // fan
    for _ in range(levels):
        node = F.sha2(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("nth", "root"))), lambda x: F.concat(x["nth"].cast("string"), F.lit(":"), x["root"])
                ),
                "|"
            ),
            256
        )
        leaves = leaves.groupBy(by, F.floor(F.col("nth") / fan).alias("up")).agg(node.alias("root")).select(by, F.col("up").alias("nth"), "root")
    return leaves.select(by, "root")


def manifest(store: DataFrame) -> DataFrame:
    """shard (-1: the corpus), n_docs, n_tokens, root, from the stored rows."""
    facts = store.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    shards = stage(facts.join(tree_roots(store.select("shard", "nth", F.hex("root").alias("root")), "shard"), "shard"), "shards")
    numbered = shards.select(F.lit(-1).alias("shard"), F.col("shard").cast("long").alias("nth"), "root")
    corpus = shards.agg(
        F.lit(-1).alias("shard"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")
    )
    return shards.unionByName(corpus.join(F.broadcast(tree_roots(numbered, "shard")), "shard", "left").select("shard", "n_docs", "n_tokens", "root"))


def write_store(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocab: str = "word_bpe_49k.json", end_id: int | None = 2,
    rows_at_once: int = 256
) -> None:
    """Encode ``docs`` and write the store (see above) at ``path``."""
    spark = docs.sparkSession
    kt = docs.schema[key].dataType.simpleString()
    refs = "array<struct<seq:int,owner:long,at:int,uses:long>>"
    shared = "array<struct<seq:int,uses:long>>"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary(vocab))
        width, dtype = enc.width, f"<u{enc.width}"
        for pdf in batches:
            for b in range(0, len(pdf), rows_at_once):
                part = pdf.iloc[b : b + rows_at_once]
                rows = []
                for t in part["_text"]:
                    ids = enc.encode(t if isinstance(t, str) else None)
                    if end_id is not None:
                        ids = np.append(ids, np.array(end_id, dtype))
                    ends, raw = boundaries(ids), ids.tobytes()
                    rows.append((
                        len(ids), np.diff([0, *ends]).astype("<i4").tobytes(),
                        b"".join([digest(raw[s * width : e * width]) for s, e in zip([0, *ends], ends, strict=False)]), raw
                    ))
                out = pd.DataFrame(rows, columns=["n_tokens", "lens", "digests", "payload"])
                out.insert(0, "rid", part["rid"].to_numpy())
                out.insert(0, "key", part["_key"].to_numpy())
                yield out

    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("rid"))
    encoded = stage(
        source.mapInPandas(encode, f"key {kt}, rid long, n_tokens long, lens binary, digests binary, payload binary"), "ids", rows_at_once=1000
    )

    # occurrences of chunks found more than once, with the first place of each
    each = F.transform(F.sequence(F.lit(0), (F.length("digests") / 16).cast("int") - 1), lambda i: F.substring("digests", i * 16 + 1, F.lit(16)))
    places = encoded.select("key", "rid", F.posexplode(each).alias("seq", "digest"))
    first = stage(
        places.groupBy("digest").agg(
            F.min(F.struct(F.col("key"), F.col("rid"), F.col("seq"))).alias("first"), F.count("*").alias("n")
        ).filter("n > 1"),
        "first-places"
    )
    repeats = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    most = max(1000, repeats // max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = join_skewed(places, first.select("digest", "first", F.col("n").alias("uses"), "n"), "digest", "n", most, "inner")
    notes = found.groupBy("rid").agg(F.collect_list(F.struct(
        "seq", F.col("first.rid").alias("owner"), F.col("first.seq").alias("at"), "uses"
    )).alias("notes"))
    starts = running_start(encoded.select("key", "rid", "n_tokens"), ["key", "rid"], "n_tokens", "start")
    meta = starts.join(notes, "rid", "left").select(
        "key", "rid", F.lit(0).alias("kind"), "start", "notes", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("binary").alias("lens"), F.lit(None).cast("binary").alias("digests"), F.lit(None).cast("binary").alias("payload")
    )
    body = encoded.select(
        "key", "rid", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast(refs).alias("notes"), "n_tokens", "lens",
        "digests", "payload"
    )
    width = encoder(vocabulary(vocab)).width

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, start, notes, nth = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            rows = []
            for key_, rid, kind, s, ns, n, lens, digests, payload in pdf.itertuples(index=False, name=None):
                if kind == 0:
                    start, notes = int(s), [] if ns is None else [dict(x) if not hasattr(x, "asDict") else x.asDict() for x in ns]
                    continue
                away = sorted((x for x in notes if (x["owner"], x["at"]) != (rid, x["seq"])), key=lambda x: x["seq"])
                own = sorted(
                    ({"seq": x["seq"], "uses": x["uses"]} for x in notes if (x["owner"], x["at"]) == (rid, x["seq"])), key=lambda x: x["seq"]
                )
                if away:
                    gone, ends = {x["seq"] for x in away}, np.cumsum(np.frombuffer(lens, "<i4")) * width
                    payload = b"".join([payload[s:e] for i, (s, e) in enumerate(zip([0, *ends], ends, strict=False)) if i not in gone])
                rows.append((shard, nth, key_, rid, start, int(n), lens, digests, away, own, payload, merkle_root(apart(digests))))
                nth += 1
            if rows:
                yield pd.DataFrame(
                    rows, columns=["shard", "nth", "key", "rid", "start", "n_tokens", "lens", "digests", "refs", "shared", "payload", "root"]
                )

    # the parts of the prefix sums, by their first rows (key and row id, so that one key's rows are spread as well): no second
    # sampling of the payloads
    place = F.struct("key", "rid")
    firsts = [r["k"] for r in starts.groupBy("_part").agg(F.min(place).alias("k")).orderBy("_part").collect()]  # a row per partition
    cuts = [F.struct(F.lit(k["key"]).cast(kt).alias("key"), F.lit(k["rid"]).cast("long").alias("rid")) for k in firsts[1:]]
    both = body.unionByName(meta).repartitionById(
        len(cuts) + 1, place_among(place, cuts).cast("int")
    ).sortWithinPartitions(F.col("key").asc_nulls_first(), "rid", "kind")
    both.mapInPandas(
        merge,
        f"shard int, nth long, key {kt}, rid long, start long, n_tokens long, lens binary, digests binary, refs {refs}, shared {shared}, payload binary, root binary"
    ).write.mode("overwrite").option("compression", "zstd").option("width", width).parquet(f"{path}/store")
    drop(encoded, starts, first)
    manifest(spark.read.parquet(f"{path}/store")).withColumn("width", F.lit(width)).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Rebuild and verify every document: ``key``, ``start``, ``n_tokens``,
    ``ids_crc32`` and, with ``ids``, the little-endian unsigned 32-bit ids."""
    store = spark.read.parquet(f"{path}/store")
    kept = spark.read.parquet(f"{path}/manifest")
    width = kept.filter("shard = -1").select("width").first()[0]
    facts = ["shard", "n_docs", "n_tokens", "root"]
    # both have a row per shard
    odd = manifest(store).select(*facts, F.lit(1).alias("side")).unionByName(kept.select(*facts, F.lit(-1).alias("side"))).groupBy(*facts).agg(F.sum("side").alias("side")).filter("side <> 0")
    if wrong := sorted({r["shard"] for r in odd.select("shard").limit(20).collect()}):
        raise ValueError(f"shards {wrong} differ from the manifest")
    kt = store.schema["key"].dataType.simpleString()
    out = f"key {kt}, rid long, start long, n_tokens long, ids_crc32 long, ids binary"
    dtype = "<u2" if width == 2 else "<u4"

    def rebuilt(row, found: dict[int, bytes]) -> tuple:
        key_, rid, start, n, lens, digests, refs, payload, root = row
        away = set() if refs is None else {x["seq"] for x in refs}
        at, parts = 0, []
        digests = apart(digests)
        for i, (k, d) in enumerate(zip(np.frombuffer(lens, "<i4").tolist(), digests, strict=True)):
            if i in away:
                piece = found[i]
            else:
                piece = payload[at : at + k * width]
                at += k * width
            if digest(piece) != d:
                raise ValueError(f"chunk {i} of row {rid} differs from its digest")
            parts.append(piece)
        if merkle_root(digests) != root:
            raise ValueError(f"row {rid} differs from its Merkle root")
        whole = np.frombuffer(b"".join(parts), dtype).astype("<u4").tobytes()
        return key_, rid, start, n, zlib.crc32(whole), whole if ids else None

    names = ["key", "rid", "start", "n_tokens", "ids_crc32", "ids"]

    def whole_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([rebuilt(r, {}) for r in pdf.itertuples(index=False, name=None)], columns=names)

    def lend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, lens, refs, shared, payload in pdf.itertuples(index=False, name=None):
                away, wanted, at = set() if refs is None else {x["seq"] for x in refs}, {x["seq"]: x["uses"] for x in shared}, 0
                for i, k in enumerate(np.frombuffer(lens, "<i4").tolist()):
                    if i not in away:
                        if i in wanted:
                            rows.append((rid, i, wanted[i], payload[at : at + k * width]))
                        at += k * width
            yield pd.DataFrame(rows, columns=["owner", "at", "uses", "piece"])

    def patched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, bytes] = {}
        for pdf in batches:
            rows = []
            for *row, kind, seq, piece in pdf.itertuples(index=False, name=None):
                if kind == 0:
                    found[int(seq)] = piece
                else:
                    rows.append(rebuilt(row, found))
                    found = {}
            if rows:
                yield pd.DataFrame(rows, columns=names)

    cols = ["key", "rid", "start", "n_tokens", "lens", "digests", "refs", "payload", "root"]
    alone = store.filter("size(refs) = 0").select(*cols).mapInPandas(whole_rows, out)
    owing = store.filter("size(refs) > 0")
    pieces = store.filter("size(shared) > 0").select("rid", "lens", "refs", "shared", "payload").mapInPandas(
        lend, "owner long, at int, uses long, piece binary"
    )
    # a chunk of many uses is there once for each thousand of them
    parts = F.ceil(F.col("uses") / 1000).cast("int")
    pieces = pieces.select("owner", "at", "piece", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    asking = owing.select("rid", F.explode("refs").alias("r")).select("rid", "r.*").withColumn(
        "salt", F.pmod(F.xxhash64("rid", "seq"), parts).cast("int")
    ).drop("uses")
    fetched = asking.join(pieces, ["owner", "at", "salt"])
    empty = {c: F.lit(None).cast(store.schema[c].dataType).alias(c) for c in cols if c != "rid"}
    asked = fetched.select(*[F.col("rid") if c == "rid" else empty[c] for c in cols], F.lit(0).alias("kind"), "seq", "piece")
    body = owing.select(*cols, F.lit(1).alias("kind"), F.lit(0).alias("seq"), F.lit(None).cast("binary").alias("piece"))
    mended = body.unionByName(asked).repartition("rid").sortWithinPartitions("rid", "kind", "seq").mapInPandas(patched, out)
    rows = alone.unionByName(mended)
    return rows if ids else rows.drop("ids")
