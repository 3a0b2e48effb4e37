"""Chat formatting in budgeted windows.

The turns of a conversation are laid end to end by a prefix sum of their tokens (words and MARKS). A
window takes turns as long as their tokens stay within NEW_TOKENS; the first that doesn't fit begins
the next one, so windows never cut a turn and no window of several turns is over budget. A turn that
is over budget by itself is a window alone. A later window repeats the system turn (the first of the
conversation, if it came before) and before its own turns as many as fit: what the system turn leaves
of HISTORY_TOKENS. A system turn longer than that is repeated all the same, without history. Repeated
turns carry another mark and are left out of the loss mask, so each assistant text is a target once.

Where windows begin is found by a fold over the token counts of conversations of up to FOLD turns. In
longer ones each turn points to the first that doesn't fit with it, and which turns are reached from
the first is found by pointer doubling.

Template: `<s>[role] text</s>` for a turn, `<h>[role] text</s>` for a repeated one. Within roles and
texts `~`, `<`, `[` and `]` are written `~0` `~1` `~2` `~3`, so control strings can't occur there
and reading back is exact.

A window has at most NEW_TOKENS + HISTORY_TOKENS turns, as each costs a token at least, and is built
alone, however long its texts; whole conversations are gathered only by `read_back`, whose digests are over all turns.

Cases: null roles and texts count as empty. Turns are ordered by turn, role and text, null first, so
ties and repeated rows have one result, and all count. A null conv_id is a conversation. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.llm.common import stored

NEW_TOKENS = 384
HISTORY_TOKENS = 128
#: Tokens of a turn's marks.
MARKS = 4
#: Turns of a conversation up to which windows are found by a fold.
FOLD = 256
ESCAPES = {"~": "~0", "<": "~1", "[": "~2", "]": "~3"}


def escape(c: Column) -> Column:
    for plain, written in ESCAPES.items():
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in reversed(ESCAPES.items()):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def _folded(budget: int) -> Column:
    """The window of a turn at `pos`, by `costs`, the tokens of its conversation's turns."""
    start = F.struct(F.lit(-1).alias("window"), F.lit(budget).cast("long").alias("used"))

    def add(held: Column, cost: Column) -> Column:
        fits = held["used"] + cost <= budget  # the first turn finds a full window, and so begins one
        return F.struct((held["window"] + F.when(fits, 0).otherwise(1)).alias("window"), F.when(fits, held["used"] + cost).otherwise(cost).cast("long").alias("used"))

    return F.aggregate(F.slice("costs", F.lit(1), F.col("pos")), start, add, lambda held: held["window"])


def _reached(turns: DataFrame) -> DataFrame:
    """conv_id, pos of the turns of (conv_id, pos, to) that are reached from pos 1 by following `to`; stored tables."""
    step = stored(turns, "jump")
    longest = step.agg(F.max("pos")).first()[0] or 0
    jumps = [step]
    while 2 ** len(jumps) < longest:
        far = jumps[-1].select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"), F.col("to").alias("_to"))
        both = jumps[-1].join(far, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("to") == F.col("_pos")))
        jumps.append(stored(both.select("conv_id", "pos", F.col("_to").alias("to")), "jump"))
    found = step.filter("pos = 1").select("conv_id", "pos")
    for jump in reversed(jumps):
        far = jump.select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"), "to")
        more = found.join(far, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos"))).select("conv_id", F.col("to").alias("pos"))
        found = stored(found.union(more).distinct(), "begin")
    return found


def _windowed(flat: DataFrame, budget: int) -> DataFrame:
    """Turns with pos, at (tokens before them) and window, all counted from the start of their conversation."""
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = flat.withColumns({"pos": F.row_number().over(conv), "at": F.sum("tokens").over(conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")})
    long = flat.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FOLD).select(F.col("conv_id").alias("_conv"))
    few = not long.isEmpty()
    short = placed.join(long, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti") if few else placed
    folded = short.withColumn("costs", F.collect_list("tokens").over(whole)).withColumn("window", _folded(budget)).drop("costs")
    if not few:
        return folded
    rest = placed.join(long, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    within = Window.partitionBy("conv_id").orderBy("at").rangeBetween(0, budget)
    last = F.max(F.struct("pos", (F.col("at") + F.col("tokens")).alias("end"))).over(within)
    to = F.when(last["end"] - F.col("at") <= budget, last["pos"] + 1).otherwise(F.greatest(last["pos"], F.col("pos") + 1))
    size = F.max("pos").over(Window.partitionBy("conv_id"))
    begins = _reached(rest.select("conv_id", "pos", to.alias("to"), size.alias("n")).filter("to <= n").drop("n").unionByName(rest.filter("pos = 1").select("conv_id", "pos", F.lit(None).cast("int").alias("to"))))
    named = begins.filter("pos is not null").select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"), F.lit(1).alias("_begins"))
    joined = rest.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    number = F.sum(F.coalesce("_begins", F.lit(0))).over(Window.partitionBy("conv_id").orderBy("pos")) - 1
    return folded.unionByName(joined.select(*rest.columns, number.cast("int").alias("window")))


def windows(turns: DataFrame, new_tokens: int = NEW_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, window, text, mask (array of start, end in code points: the loss spans of text)."""
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    flat = flat.withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")) + MARKS)
    placed = _windowed(flat, new_tokens)
    whole = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    soon = Window.partitionBy("conv_id").orderBy("at").rangeBetween(1, history_tokens)
    begins = F.coalesce(F.lag("window").over(Window.partitionBy("conv_id").orderBy("at")), F.lit(-1)) != F.col("window")
    rows = placed.withColumns({"begins": begins, "head": F.first(F.when(F.col("role") == "system", F.struct("pos", "role", "text", "tokens")), ignorenulls=True).over(whole)})
    rows = rows.withColumn("soon", F.collect_list(F.when(F.col("begins"), F.struct("window", "at"))).over(soon))
    room = F.lit(history_tokens) - F.coalesce(F.col("head.tokens"), F.lit(0))
    entry = lambda window, again: F.struct(window.cast("int").alias("window"), F.col("pos").alias("pos"), F.lit(again).alias("again"), F.col("role").alias("role"), F.col("text").alias("text"))
    own, again = F.array(entry(F.col("window"), False)), F.transform(F.filter("soon", lambda w: w["at"] - F.col("at") <= room), lambda w: entry(w["window"], True))
    opening = F.when(F.col("begins") & (F.col("head.pos") < F.col("pos")), F.array(F.struct(F.col("window").cast("int").alias("window"), F.col("head.pos").alias("pos"), F.lit(True).alias("again"), F.col("head.role").alias("role"), F.col("head.text").alias("text"))))
    every = F.concat(own, again, F.coalesce(opening, F.filter(own, lambda e: F.lit(False))))
    members = rows.select("conv_id", F.explode(every).alias("e")).select("conv_id", "e.*")
    # the system turn may be in reach as history as well
    held = members.groupBy("conv_id", "window").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("pos", "again", "role", "text")))).alias("t"))
    pieces = F.transform(
        "t",
        lambda e: F.struct(
            F.concat(F.when(e["again"], "<h>[").otherwise("<s>["), escape(e["role"]), F.lit("] ")).alias("front"),
            escape(e["text"]).alias("body"),
            (~e["again"] & (e["role"] == "assistant")).alias("loss"),
        ),
    )
    held = held.select("conv_id", "window", pieces.alias("p"))
    span = "named_struct('start', a.at + length(e.front), 'end', a.at + length(e.front) + length(e.body))"
    mask = F.expr(
        "aggregate(p, named_struct('at', 0, 'mask', cast(array() as array<struct<start:int,end:int>>)), "
        f"(a, e) -> named_struct('at', a.at + length(e.front) + length(e.body) + 4, 'mask', if(e.loss, concat(a.mask, array({span})), a.mask)), a -> a.mask)"
    )
    return held.select("conv_id", "window", F.array_join(F.transform("p", lambda e: F.concat(e["front"], e["body"], F.lit("</s>"))), "").alias("text"), mask.alias("mask"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, window, place, again, role, text: the turns that a formatted text holds."""
    pieces = F.filter(F.split("text", "</s>", -1), lambda x: x != "")
    flat = formatted.select("conv_id", "window", F.posexplode(pieces).alias("place", "piece"))
    end = F.instr("piece", "] ")
    role, text = F.expr("substring(piece, 5, instr(piece, '] ') - 5)"), F.expr("substring(piece, instr(piece, '] ') + 2)")
    return flat.filter(end > 0).select("conv_id", "window", "place", F.col("piece").startswith("<h>").alias("again"), unescape(role).alias("role"), unescape(text).alias("text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns, loss, formatted_chars: what the windows of a conversation say."""
    turns = read_turns(formatted).filter("not again").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "place", "role", "text"))).alias("t"))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"]))), "")
    marked = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", loss.alias("loss")))).alias("l"), F.sum(F.length("text")).alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda e: F.concat(e["role"], F.lit("\n"), e["text"], F.lit("\n"))), "")
    right = turns.select(F.col("conv_id").alias("c"), F.size("t").cast("long").alias("n_turns"), said.alias("turns"))
    both = marked.join(right, F.col("conv_id").eqNullSafe(F.col("c")))
    return both.select("conv_id", "n_turns", "turns", F.array_join(F.transform("l", lambda e: e["loss"]), "").alias("loss"), "formatted_chars")
