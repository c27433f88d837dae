"""Chat formatting in budgeted windows.

Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``; control strings
inside texts are escaped reversibly.  A conversation that is within the budget
is one window.  Others are cut at turns by prefix sums of turn tokens: a window
starts with the conversation's first system turn, repeats the turns before it that
fit in the history allowance, and takes as many new turns as the budget then
leaves.  Where the next window would begin is told for every turn at once, and the
beginnings are gathered by pointer jumping.  The loss mask covers the texts of new
assistant turns only, so a target that is repeated as history is masked there.

Running sums over a conversation are carried across range partitions, and
windows are assembled from bounded groups: no task needs a whole conversation.

A turn's tokens are given as a column (``token_counts`` has those of a
vocabulary, the marks' own to be added) or told from its pre-tokens.

A window's turns are within the budget, but for two cases in which nothing may be
left out: a turn that alone is over what the budget leaves has a window of its own
(nothing is repeated there), and a system turn that leaves less than 32 tokens is
retained all the same.  Turns cost one token at least.

Null text is empty, null role the empty role; a null turn number comes first;
ties of turn number are ordered by role, then text; repeated rows are separate
turns.  An empty table gives no windows.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop, ordered, stage

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Backslashes doubled, then ``<|`` broken by one: no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """Also without line feeds, since the role ends at one."""
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


#: How byte-level vocabularies split text before their merges (as Java writes it).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def turn_tokens(text: Column, piece: int = 3) -> Column:
    """A turn's cost where no token column is given: four for its marks, and for
    each pre-token (which no token crosses) one for every ``piece`` bytes begun."""
    each = F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))
    return (F.aggregate(each, F.lit(0).cast("long"), lambda s, p: s + F.ceil(F.octet_length(p) / piece)) + 4).cast("long")


def _last_at_most(points: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``found``: the largest ``v`` of ``points`` of the same conversation that
    is at most ``x`` and no more than ``width`` below it, else null.  Both meet in bands
    of ``width``, which hold bounded numbers of positions."""
    band = lambda c: F.floor(F.col(c) / width)
    asked = rows.withColumn("_row", F.struct(*rows.columns))
    here = asked.select("conv_id", band("x").alias("_band"), F.col("x").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_v"), "_row")
    below = asked.select("conv_id", (band("x") - 1).alias("_band"), F.col("x").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_v"), "_row")
    there = points.select("conv_id", band("v").alias("_band"), F.col("v").alias("_at"), F.lit(0).alias("_kind"), F.col("v").alias("_v"))
    order = Window.partitionBy("conv_id", "_band").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = here.unionByName(below).unionByName(there, allowMissingColumns=True).withColumn("_found", F.last("_v", True).over(order)).filter("_kind = 1")
    best = met.groupBy("conv_id", "_row").agg(F.max("_found").alias("found"))
    return best.select("_row.*", F.when(F.col("found") >= F.col("_row.x") - width, F.col("found")).alias("found"))


def _window_starts(turns: DataFrame, budget: int, history: int) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, v): where windows of long conversations begin, as sums of tokens,
    and the staged tables behind it.  From wherever a window could begin, the next
    one is told first: after the last turn that ends within the budget, beside what
    is repeated.  Then the beginnings that are reached from 0 are gathered by
    pointer jumping, in as many rounds as the logarithm of a conversation's windows."""
    allow = F.least(F.lit(history), F.greatest(F.lit(0), F.col("room") - F.col("n")))
    # what is repeated begins at the first turn within the allowance: looked up from above
    asked = turns.select("conv_id", "begin", "end", "room", "total", (-(F.col("begin") - allow)).alias("x"))
    back = _last_at_most(turns.select("conv_id", (-F.col("begin")).alias("v")), asked, budget)
    repeated = F.col("begin") + F.coalesce(F.col("found"), -F.col("begin"))
    ahead = back.withColumn("x", F.col("begin") + F.col("room") - repeated).drop("found")
    step = _last_at_most(turns.select("conv_id", F.col("end").alias("v")), ahead, budget)
    nxt = F.greatest("end", F.coalesce("found", "end"))
    jump = stage(step.filter(nxt < F.col("total")).select("conv_id", F.col("begin").alias("v"), nxt.alias("to")), "window-steps")
    made, reached = [jump], stage(turns.filter("begin = 0").select("conv_id", F.col("begin").alias("v")), "window-starts")
    n, before = reached.count(), -1
    while n > before:
        made.append(reached)
        same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
        more = reached.alias("a").join(jump.alias("b"), same & (F.col("a.v") == F.col("b.v"))).select("a.conv_id", F.col("b.to").alias("v"))
        reached = stage(reached.unionByName(more).distinct(), "window-starts")
        before, n = n, reached.count()
        jump = stage(jump.alias("a").join(jump.alias("b"), same & (F.col("a.to") == F.col("b.v"))).select("a.conv_id", "a.v", "b.to"), "window-steps")
        made.append(jump)
    return reached, [*made, reached]


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 512, tokens: str | None = None) -> DataFrame:
    """``turns``: conv_id, turn, role, text, and ``tokens``, if a column is named.
    Per window: conv_id, window (from
    0), formatted, ``turns`` (array of ord, fresh: whether its first showing)
    and ``loss`` (array of ord, at, chars: code points of ``formatted``)."""
    said = F.coalesce("text", F.lit(""))
    cost = F.col(tokens).cast("long") if tokens else turn_tokens(said)
    t = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), said.alias("text"), F.greatest(F.lit(1), cost).alias("n")
    ).withColumn("rid", F.monotonically_increasing_id())
    t = stage(t, "turns")

    # order and prefix sums by conversation, over small rows
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "rid"]
    small = t.select("conv_id", "turn", "role", "n", "rid", F.sha2("text", 256).alias("digest"))
    order = ordered(small, *by, name="turn-order")
    local = Window.partitionBy("_part", "conv_id").orderBy("_pos")
    o = order.withColumn("_sum", F.sum("n").over(local.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_ord", F.row_number().over(local))
    # what a conversation has in earlier parts, in all of them, and its first system turn: a row per part
    system = F.min(F.when(F.col("role") == "system", F.struct("_ord", "rid", "n")))
    carry = o.groupBy("conv_id", "_part").agg(F.sum("n").alias("s"), F.count("*").alias("c"), system.alias("first"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumns({
        "s0": F.coalesce(F.sum("s").over(earlier), F.lit(0)), "c0": F.coalesce(F.sum("c").over(earlier), F.lit(0)), "total": F.sum("s").over(whole)
    })
    first = F.when(F.col("first").isNotNull(), F.struct((F.col("c0") + F.col("first._ord") - 1).alias("ord"), "first.rid", "first.n"))
    carry = carry.select("conv_id", "_part", "s0", "c0", "total", F.min(first).over(whole).alias("system"))
    o = o.alias("o").join(carry.alias("c"), F.col("o.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("o._part") == F.col("c._part")))
    system_n, ord_ = F.coalesce(F.col("system.n"), F.lit(0)), F.col("_ord") + F.col("c0") - 1
    q = o.select(
        "o.conv_id", "o.role", "o.n", "o.rid", ord_.alias("ord"), F.coalesce(F.col("o.rid") == F.col("system.rid"), F.lit(False)).alias("is_system"),
        # sums without the system turn
        (F.col("_sum") + F.col("s0") - F.when(ord_ >= F.col("system.ord"), system_n).otherwise(0)).alias("end"),
        (F.col("total") - system_n).alias("total"), F.greatest(F.lit(32), F.lit(budget) - system_n).alias("room")
    )
    q = stage(q.withColumn("begin", F.when(F.col("is_system"), F.col("end")).otherwise(F.col("end") - F.col("n"))), "turn-sums")
    turns_only = q.filter("NOT is_system")
    starts, working = _window_starts(turns_only.filter("total > room"), budget, history)
    # a turn is in the last window that begins no later than it does
    long = _last_at_most(starts, turns_only.filter("total > room").withColumn("x", F.col("begin")), budget).drop("x").withColumnRenamed("found", "slot")
    turns_only = stage(turns_only.filter("total <= room").withColumn("slot", F.lit(0).cast("long")).unionByName(long), "turn-slots")
    slots = turns_only.groupBy("conv_id", "slot").agg(F.min(F.struct("begin", F.least(F.lit(history), F.greatest(F.lit(0), F.col("room") - F.col("n"))).alias("allow"))).alias("p"))
    slots = slots.select("conv_id", "slot", F.col("p.begin").alias("p0"), F.col("p.allow").alias("allow"))
    bare = q.filter("is_system AND total = 0").select(  # a conversation of a system turn alone has one window
        "conv_id", *[F.lit(0).cast("long").alias(c) for c in ("slot", "p0", "allow")]
    )
    slots = stage(slots.unionByName(bare), "slots")

    fresh = turns_only.select("conv_id", "slot", "rid", "ord", F.lit(1).alias("place"), F.lit(True).alias("fresh"))
    # history: turns before a window's first that begin within the allowance
    bands = turns_only.filter(F.col("n") <= history).select(
        "conv_id", "rid", "ord", "begin", "end",
        F.explode(F.array_distinct(F.array(F.floor(F.col("end") / history), F.floor((F.col("begin") + history) / history)))).alias("band")
    )
    opened = slots.withColumn("band", F.floor(F.col("p0") / history))
    old = bands.alias("h").join(
        opened.alias("w"),
        F.col("h.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("h.band") == F.col("w.band")) & (F.col("h.end") <= F.col("w.p0")) & (F.col("h.begin") >= F.col("w.p0") - F.col("w.allow"))
    )
    old = old.select("h.conv_id", "w.slot", "h.rid", "h.ord", F.lit(1).alias("place"), F.lit(False).alias("fresh"))
    first = slots.groupBy("conv_id").agg(F.min("slot").alias("slot0"))
    heads = q.filter("is_system").alias("s").join(
        slots.alias("w"), F.col("s.conv_id").eqNullSafe(F.col("w.conv_id"))
    ).join(first.alias("f"), F.col("s.conv_id").eqNullSafe(F.col("f.conv_id")))
    heads = heads.select("s.conv_id", "w.slot", "s.rid", "s.ord", F.lit(0).alias("place"), (F.col("w.slot") == F.col("f.slot0")).alias("fresh"))

    shown = fresh.unionByName(old).unionByName(heads).join(t.select("rid", "role", "text"), "rid")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    shown = shown.withColumn("said", escape(F.col("text"))).withColumn("line", F.concat(head, "said", F.lit(END + "\n"))).withColumn("lead", F.length(head))
    inside = Window.partitionBy("conv_id", "slot").orderBy("place", "ord").rowsBetween(Window.unboundedPreceding, -1)
    shown = shown.withColumn("at", F.coalesce(F.sum(F.length("line")).over(inside), F.lit(0)) + F.col("lead"))
    # bounded groups: a window's turns cost at least four tokens each
    item = F.struct(
        "place", "ord", "fresh", "line",
        F.struct("ord", F.col("at").cast("long").alias("at"), F.length("said").cast("long").alias("chars")).alias("span"),
        (F.col("fresh") & (F.col("role") == "assistant")).alias("target")
    )
    made = shown.groupBy("conv_id", "slot").agg(F.array_sort(F.collect_list(item)).alias("a"))
    made = made.select(
        "conv_id",
        F.col("slot").alias("window"),
        F.array_join(F.transform("a", lambda x: x["line"]), "").alias("formatted"),
        F.transform("a", lambda x: F.struct(x["ord"].alias("ord"), x["fresh"].alias("fresh"))).alias("turns"),
        F.transform(F.filter("a", lambda x: x["target"]), lambda x: x["span"]).alias("loss"),
    )
    out = stage(made, "chat-windows")
    drop(t, order, q, turns_only, slots, *working)
    return out


def read_turns(windows: DataFrame) -> DataFrame:
    """The turns again, from the formatted text: conv_id, ord, role, text, and
    ``loss``: the text under the mask (null where there is none)."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    rows = windows.select(
        "conv_id", "window", "formatted", "loss",
        F.posexplode(F.arrays_zip(F.col("turns").alias("t"), F.slice(pieces, 1, F.size("turns")).alias("piece"))).alias("i", "z")
    )
    body = F.substring(F.col("z.piece"), len(START) + 1, 2**31 - 1 - len(START))
    rows = rows.filter("z.t.fresh").withColumn("body", body).withColumn("cut", F.instr("body", "\n"))
    span = F.element_at(F.filter("loss", lambda s: s["ord"] == F.col("z.t.ord")), 1)
    rows = rows.withColumn("span", F.when(F.exists("loss", lambda s: s["ord"] == F.col("z.t.ord")), span))
    return rows.select(
        "conv_id",
        F.col("z.t.ord").alias("ord"),
        unescape_role(F.expr("substring(body, 1, cut - 1)")).alias("role"),
        unescape(F.expr("substring(body, cut + 1)")).alias("text"),
        unescape(F.expr("substring(formatted, cast(span.at + 1 as int), cast(span.chars as int))")).alias("loss"),
    )


def digest(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from the windows.  Its digests need
    the conversation's text in one value."""
    turns = read_turns(windows)
    per = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("ord", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("s"), "loss"))).alias("a")
    )
    whole = F.array_join(F.transform("a", lambda x: x["s"]), "")
    loss = F.array_join(F.transform(F.filter("a", lambda x: x["loss"].isNotNull()), lambda x: x["loss"]), "")
    per = per.select(
        "conv_id", "n_turns", F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256")
    )
    sizes = windows.groupBy("conv_id").agg(F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    return per.alias("p").join(sizes.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.*", "s.formatted_chars")
