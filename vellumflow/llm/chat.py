"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as '### role: text</turn>' and a line end. Inside roles and texts the characters of these marks are
escaped (see ESCAPES), so no text can forge a turn, and unescaping gives the text back.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. What the system turns and the history leave of the
budget is the room of a span: room by room, the turns that lie inside one are a span, and a turn across the border joins the
span behind it if both fit, else it is a span of its own. Each span is one window: the leading system turns again, then as
many last turns of the span before as fit into the history budget, then the span. A window keeps to the budget unless a
single turn and the system turns exceed it. The loss mask lists the assistant texts of the span itself; repeated turns are
never targets, so each assistant text is a target exactly once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.shared import words_of

BUDGET = 512  # tokens (words and MARK_TOKENS) of a window
HISTORY = 128  # of these, for repeated turns
MARK_TOKENS = 2
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: Fixed values, in the order of escaping; after the first, a backslash always starts an escape.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    """Reversible: no '#', no '<' and, in roles, no ':' is left."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES if role else ESCAPES[:3], text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, target_role: str = "assistant", system_role: str = "system") -> DataFrame:
    """conv_id, window (from 1), text, loss: array of (start, length) in code points, n_system, n_history.

    turns: conv_id, turn, role, text. Turns come by number (null last), ties by role and text; rows that repeat a turn are
    turns of their own. Null roles and texts count as empty, a null conv_id is one conversation. A turn longer than its
    room stays whole, alone in its span. System turns count as such only before the first other turn. No rows give no rows; extra columns
    are ignored. One exchange, by conversation.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", words_of(F.col("text")) + MARK_TOKENS)
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.asc_nulls_last("turn"), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.row_number().over(order))
    by_place = conv.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("leading", F.max((F.col("role") != system_role).cast("int")).over(so_far) == 0)
    before = F.sum(F.when(F.col("leading"), 0).otherwise(F.col("tokens"))).over(by_place) - F.col("tokens")
    system = F.coalesce(F.sum(F.when(F.col("leading"), F.col("tokens"))).over(conv), F.lit(0))
    rows = rows.withColumns({"before": before, "system": system, "room": F.greatest(budget - system - history, F.lit(1))})
    # where a turn ends: in its own room, or beyond the border, where the next turn begins
    after = F.col("before") + F.col("tokens")
    rows = rows.withColumn("across", F.floor((after - 1) / F.col("room")) > F.floor(F.col("before") / F.col("room")))
    rows = rows.withColumn("at", F.when(~F.col("leading"), F.floor(F.when(F.col("across"), after).otherwise(F.col("before")) / F.col("room"))))
    inside = F.coalesce(F.sum(F.when(~F.col("across"), F.col("tokens"))).over(Window.partitionBy("conv_id", "at")), F.lit(0))
    rows = rows.withColumn("part", F.col("at") * 2 + F.when(F.col("across") & (F.col("tokens") + inside > F.col("room")), 0).otherwise(1))
    opens = F.col("part").isNotNull() & ~F.col("part").eqNullSafe(F.lag("part").over(conv.orderBy("place")))
    rows = rows.withColumn("span", F.sum(opens.cast("int")).over(by_place))
    rows = rows.withColumn("spans", F.max("span").over(conv))
    to_end = F.sum("tokens").over(Window.partitionBy("conv_id", "span").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("span_tokens", F.sum(F.when(~F.col("leading"), F.col("tokens"))).over(Window.partitionBy("conv_id", "span")))
    follows = F.first("span_tokens").over(conv.orderBy("span").rangeBetween(1, 1))
    rows = rows.withColumn("repeats", (to_end <= F.least(F.lit(history), budget - F.col("system") - follows)) & (F.col("span") < F.col("spans")))
    # kind: 0 system, 1 history, 2 the span itself
    spot = lambda window, kind: F.struct(window.cast("int").alias("window"), F.lit(kind).alias("kind"))
    own = F.array(spot(F.col("span"), 2))
    spots = (
        F.when(F.col("leading"), F.transform(F.sequence(F.lit(1), F.greatest(F.col("spans"), F.lit(1))), lambda w: spot(w, 0)))
        .when(F.col("repeats"), F.array(spot(F.col("span"), 2), spot(F.col("span") + 1, 1)))
        .otherwise(own)
    )
    placed = rows.withColumn("spot", F.explode(spots)).select("conv_id", "place", "role", "text", "spot.window", "spot.kind")
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(COLON))
    body = escape(F.col("text"))
    placed = placed.select("conv_id", "window", "place", "kind", "role", head.alias("head"), body.alias("body"))
    placed = placed.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    ahead = Window.partitionBy("conv_id", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.char_length("piece")).over(ahead) - F.char_length("piece") + F.char_length("head")
    target = (F.col("role") == target_role) & (F.col("kind") == 2)
    placed = placed.withColumn("loss", F.when(target, F.struct(start.alias("start"), F.char_length("body").cast("long").alias("length"))))
    return placed.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "").alias("text"),
        F.array_sort(F.collect_list("loss")).alias("loss"),
        F.count_if(F.col("kind") == 0).alias("n_system"),
        F.count_if(F.col("kind") == 1).alias("n_history"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns: array of (role, text) that are new in the window, targets: array of the texts under the loss mask.

    The first window of a conversation gives its system turns, later ones leave them out with the history.
    """
    pieces = F.split(F.col("text"), CLOSE)
    skipped = F.when(F.col("window") == 1, F.lit(0)).otherwise((F.col("n_system") + F.col("n_history")).cast("int"))
    new = F.slice(pieces, skipped + 1, F.size(pieces) - 1 - skipped)
    role = lambda p: F.substring_index(p, COLON, 1)
    turn = lambda p: F.struct(unescape(F.substr(role(p), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(p, F.char_length(role(p)) + F.lit(len(COLON) + 1))).alias("text"))
    under = lambda m: unescape(F.substr(F.col("text"), (m["start"] + 1).cast("int"), m["length"].cast("int")))
    return windows.select("conv_id", "window", F.transform(new, turn).alias("turns"), F.transform("loss", under).alias("targets"), F.char_length("text").cast("long").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = read_windows(windows).select(
        "conv_id", "window", "chars",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("loss"),
    )
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda w: w[c]), "")
    whole = read.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), in_order("said").alias("said"), in_order("loss").alias("loss"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    return whole.select(
        "conv_id", "n_turns",
        F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )
