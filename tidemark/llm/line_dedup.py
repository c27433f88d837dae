"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of words (runs between blanks, lower-cased);
the edit distance counts inserted, deleted and replaced words, and ``edits`` (0
or 1) is the bound.  Every variant of a line within the bound is emitted as a
hashed key: the line itself, and the line less each one of its words, with the
place of the gap.  Lines of a common variant are at most one edit apart where
their gaps are at the same place (a replaced word), or where one of them is the
variant itself (an inserted word).  Each line is therefore paired only with the
earliest line of its variant and gap and with the variant itself, never with
all; the distance of each pair is verified, and the earlier line stays.

Equal lines are one line first, with its earliest place.  Most distinct lines
have no relative, which cheap keys tell: of two lines within one edit, the first
half or the last half of the shorter is found in both.  Only lines that share a
half emit variants.

A line goes if an earlier line is equal or within the bound; so the earliest of
a group always stays.  Earlier: smaller key, then smaller digest of the text,
then line number.  Documents are known by key and 128-bit digest of their text,
distinct lines by that of their words.  Of lines of fewer than ``least_words`` words one word is too much, so
their edits are counted in characters, in the same way: one, if they have at
least ``least_chars`` of them, and none below.  Lines of fewer words and lines
of more are compared only with their like.  Null text stays null; lines without words
never go.  A document of which nothing but such lines is left is dropped, or
with ``keep_empty`` kept.  Rows of equal key and text count as one document and
are kept or cut alike.  An empty table gives no rows.  Only DataFrame and SQL
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, drop, ordered, stage

GAP = "[\\x20\\x09-\\x0D]+"


def words_of(line: Column) -> Column:
    """Lower-cased words; of a line without any, one empty string."""
    return F.split(F.lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))), GAP)


def digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def tokens_of(words: Column, least_words: int, least_chars: int) -> Column:
    """What edits are counted in: words, or characters where there are fewer
    words; null if the line must be equal.  A blank before each character keeps
    it apart from words."""
    line = F.array_join(words, " ")
    chars = F.transform(F.split(line, ""), lambda c: F.concat(F.lit(" "), c))
    return F.when(F.size(words) >= least_words, words).when(F.length(line) >= least_chars, chars)


def _half_keys(words: Column, line: Column, least_words: int, least_chars: int) -> Column:
    """Hashes of the first and of the last half of a line's tokens, for lines of
    its length and of one token less; null if the line must be equal."""

    def keys(n: Column, kind: int, part) -> Column:
        out = []
        for m in (n, n - 1):
            h = F.floor(m / 2).cast("int")
            out += [F.xxhash64(F.lit(kind), m, part(F.lit(1), h)), F.xxhash64(F.lit(kind + 1), m, part(n - m + h + 1, m - h))]
        return F.array(*out)

    by_word = keys(F.size(words), 1, lambda at, size: F.array_join(F.slice(words, at, size), " "))
    by_char = keys(F.length(line), 3, lambda at, size: F.substring(line, at, size))
    return F.when(F.size(words) >= least_words, by_word).when(F.length(line) >= least_chars, by_char)


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one edit apart: what lies between
    their common head and their common tail is at most one word of each."""
    short = F.least(F.size(a), F.size(b))

    def same(at) -> Column:
        met = F.transform(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), at)
        first = F.array_position(met, F.lit(False))  # 0 if there is no difference
        return F.when(first == 0, short).otherwise(F.least(first - 1, short))

    head = same(lambda i: F.coalesce(F.get(a, i - 1) == F.get(b, i - 1), F.lit(False)))
    tail = same(lambda i: F.coalesce(F.get(a, F.size(a) - i) == F.get(b, F.size(b) - i), F.lit(False)))
    return F.greatest(F.size(a), F.size(b)) - F.least(head + tail, short) <= 1


def split_lines(docs: DataFrame, key: str, text: str, least_words: int, least_chars: int) -> DataFrame:
    """k, d (digest of the text), at (from 0), h (digest of the words; null if
    the line has none), halves (null if the line must be equal).
    Staged: texts are taken apart once, and no filter repeats the work."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL").withColumn("d", digest(F.col("t")))
    lines = rows.select("k", "d", F.posexplode(F.split("t", "\n")).alias("at", "line"))
    lines = lines.select("k", "d", "at", words_of(F.col("line")).alias("w")).withColumn("x", F.array_join("w", " "))
    halves = _half_keys(F.col("w"), F.col("x"), least_words, least_chars)
    return stage(lines.select("k", "d", "at", F.when(F.col("x") != "", digest(F.col("x"))).alias("h"), halves.alias("halves")), "lines")


def line_verdicts(docs: DataFrame, lines: DataFrame, key: str, text: str, least_words: int, least_chars: int) -> DataFrame:
    """``lines`` as of ``split_lines``.  For each distinct line of which some occurrence goes: h, p (place of its
    first occurrence), gone (whether that goes as well: it is near an earlier
    line)."""
    places = lines.select("h", F.struct("k", "d", "at").alias("p"), "halves")
    first = stage(
        places.groupBy("h").agg(F.min("p").alias("p"), F.count("*").alias("c"), F.first("halves").alias("halves")).filter("h IS NOT NULL"),
        "first-lines"
    )

    halves = first.filter("halves IS NOT NULL").select("h", F.explode("halves").alias("half"))
    common = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("half")
    near = halves.join(common, "half").select("h").distinct().join(first.select("h", "p"), "h")
    # numbers in order of place stand for lines from here on
    placed_lines = ordered(near, F.col("p.k").asc_nulls_first(), "p.d", "p.at", name="near-lines")
    near = stage(placed_lines.select("h", "p", (F.shiftleft(F.col("_part").cast("long"), 40) + F.col("_pos")).alias("ord")), "near-lines")

    # their tokens, from the document of the first occurrence
    spots = stage(
        near.groupBy(F.col("p.k").alias("k"), F.col("p.d").alias("d")).agg(F.collect_list(F.struct(F.col("p.at").alias("at"), "ord")).alias("spots")),
        "near-spots"
    )
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL").withColumn("d", digest(F.col("t"))).alias("r").join(
        broadcast_if_small(spots).alias("s"), F.col("r.k").eqNullSafe(F.col("s.k")) & (F.col("r.d") == F.col("s.d"))
    )
    bound = F.array(F.struct(F.split("r.t", "\n").alias("lines"), "s.spots"))  # split once, not for each spot
    found = found.select(F.explode(F.flatten(F.transform(
        bound, lambda b: F.transform(b["spots"], lambda z: F.struct(z["ord"].alias("ord"), F.get(b["lines"], z["at"]).alias("line")))
    ))).alias("z"))
    texts = found.select("z.ord", words_of(F.col("z.line")).alias("w")).select(
        "ord", tokens_of(F.col("w"), least_words, least_chars).alias("w")
    ).groupBy("ord").agg(F.first("w").alias("w"))
    texts = stage(texts, "near-texts")

    # variants: hashes of (word, place) folded by exclusive or, the places after a gap shifted
    term = lambda word, at: F.xxhash64(word, at)
    placed = texts.select("ord", F.posexplode("w").alias("i", "x")).select(
        "ord", "i", term(F.col("x"), F.col("i")).alias("a"), term(F.col("x"), F.col("i") - 1).alias("b")
    )
    upto = Window.partitionBy("ord").orderBy("i")
    whole = Window.partitionBy("ord")
    before = F.bit_xor("a").over(upto).bitwiseXOR(F.col("a"))
    after = F.bit_xor("b").over(whole).bitwiseXOR(F.bit_xor("b").over(upto))
    less = placed.select("ord", F.col("i"), before.bitwiseXOR(after).alias("v"))
    own = texts.select(
        "ord", F.lit(-1).alias("i"),
        F.aggregate(F.transform("w", lambda x, i: term(x, i)), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)).alias("v")
    )
    variants = stage(less.unionByName(own.select("ord", "i", "v")), "variants")
    met = variants.groupBy("v").agg(
        F.min("ord").alias("lead"), F.max("ord").alias("last"), F.min(F.when(F.col("i") == -1, F.col("ord"))).alias("self")
    ).filter("lead <> last").drop("last")
    met = stage(variants.join(met, "v"), "met-variants")
    drop(variants)
    same_gap = met.groupBy("v", "i").agg(F.min("ord").alias("g"))
    pairs = (
        met.join(same_gap, ["v", "i"]).select("ord", "g")
        .unionByName(met.filter("self IS NOT NULL").select("ord", F.col("self").alias("g")))
        .unionByName(met.filter("i = -1").select("ord", F.col("lead").alias("g")))
    ).filter("g < ord").distinct()
    checked = pairs.join(texts, "ord").join(
        texts.select(F.col("ord").alias("g"), F.col("w").alias("x")), "g"
    ).filter(within_one(F.col("w"), F.col("x")))
    gone = checked.select("ord").distinct().join(near.select("ord", "h"), "ord").select("h", F.lit(True).alias("gone"))
    verdicts = first.select("h", "p", "c").join(gone, "h", "left").filter("c > 1 OR gone").select(
        "h", "p", F.coalesce("gone", F.lit(False)).alias("gone")
    )
    verdicts = stage(verdicts, "line-verdicts")
    drop(first, placed_lines, near, spots, texts, met)
    return verdicts


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = 1, least_words: int = 8, least_chars: int = 16, keep_empty: bool = False
) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and ``n_lines`` and
    ``n_dropped`` (of the whole text) added."""
    if edits not in (0, 1):
        raise ValueError("the bound is 0 or 1 edits")
    least = (least_words, least_chars) if edits else (1 << 30, 1 << 30)
    lines = split_lines(docs, key, text, *least)
    verdicts = line_verdicts(docs, lines, key, text, *least)
    cut = lines.select("k", "d", "at", "h").join(broadcast_if_small(verdicts), "h").filter(F.col("gone") | ~F.struct("k", "d", "at").eqNullSafe(F.col("p")))
    # an occurrence in each row of equal key and text is one place
    cut = cut.select("k", "d", "at").distinct().groupBy("k", "d").agg(F.sort_array(F.collect_list("at")).alias("cut"))
    cut = stage(cut, "cut-lines")
    drop(lines, verdicts)
    rows = docs.withColumn("_d", digest(F.col(text))).alias("r").join(
        broadcast_if_small(cut).alias("c"), F.col(f"r.{key}").eqNullSafe(F.col("c.k")) & (F.col("r._d") == F.col("c.d")), "left"
    )
    # the runs of lines between the places that go; bound once, since a lambda computes its body anew each time
    n_lines = F.octet_length(F.col(f"r.{text}")) - F.octet_length(F.replace(F.col(f"r.{text}"), F.lit("\n"), F.lit(""))) + 1
    ends = F.concat(F.array(F.lit(-1)), F.col("c.cut"), F.array(n_lines))
    run = lambda s, j: F.slice(s["lines"], F.get(s["ends"], j - 1) + 2, F.get(s["ends"], j) - F.get(s["ends"], j - 1) - 1)
    bound = F.array(F.struct(F.split(F.col(f"r.{text}"), "\n").alias("lines"), ends.alias("ends")))
    kept = F.flatten(F.flatten(F.transform(bound, lambda s: F.transform(F.sequence(F.lit(1), F.size(s["ends"]) - 1), lambda j: run(s, j)))))
    left = F.when(F.col("c.cut").isNull(), F.col(f"r.{text}")).otherwise(F.array_join(kept, "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = rows.select(
        *[left.alias(c) if c == text else F.col(f"r.{c}") for c in names],
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("c.cut"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    if not keep_empty:
        out = out.filter((F.col("n_dropped") == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    return out
