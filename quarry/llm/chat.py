"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are laid out on a line of tokens by prefix sums; windows are turn-aligned spans
of that line. Each window shows the system turn, a limited tail of the span before it
(history) and its own turns. Only assistant texts of a window's own turns are under
the loss mask; what is repeated is masked.

Template, per turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Control
strings inside texts get a backslash after their first character (one more where there
are some already), so no text can forge a mark and the change can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, as texts must not hold them raw.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join("".join("\\" + c if c in "|[]/<>" else c for c in s[1:]) for s in CONTROL)
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
MARK_TOKENS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_TAILS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_TAILS})", "$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(df: DataFrame, budget: int = 2048, history: int = 256, conv_id: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: conv_id, window (increasing inside a conversation), text (the formatted
    window), repeated (turns at its front that earlier windows have shown: system turn and
    history), n_turns (its own), n_tokens, over_budget, and loss: spans (start from 0, length;
    characters of ``text``) of the assistant texts among its own turns.

    Tokens are words and single marks, plus MARK_TOKENS a turn. A window holds at most ``budget`` of them, of
    which at most ``history`` are repeated turns; a turn longer than half of what the
    system turn and history leave gets a window of its own, without history, and only such a turn
    (or a system turn beyond the budget) can exceed it, marked over_budget.

    Rows are ordered by (turn, role, text), nulls first; repeated rows are turns each. Null roles
    and texts are empty strings, a null conv_id is a conversation; the first turn is the
    system turn if its role is "system". An empty table gives no rows. Other columns are not looked at.
    """
    turns = df.select(df[conv_id].alias("conv_id"), df[turn].alias("turn"),
                      F.coalesce(df[role], F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("body"))
    conv = Window.partitionBy("conv_id")
    line = conv.orderBy("turn", "role", "body")
    turns = (turns.withColumn("n", F.row_number().over(line))
             .withColumn("tokens", (F.regexp_count("body", F.lit(_TOKEN)) + MARK_TOKENS).cast("long"))
             .withColumn("is_system", (F.col("n") == 1) & (F.col("role") == "system"))
             .withColumn("shown", F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n")))
             .withColumn("body", escape(F.col("body"))))
    whole = conv.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    room = F.greatest(F.lit(budget - history) - F.sum(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(whole),
                      F.lit(1))
    turns = turns.withColumn("room", room).withColumn("long", (F.col("tokens") * 2 > F.col("room")) & ~F.col("is_system"))
    largest = F.max(F.when(~F.col("long") & ~F.col("is_system"), F.col("tokens")).otherwise(0)).over(whole)
    # a span starts every `step` tokens; with turns of at most room - step tokens it stays within the room
    turns = turns.withColumn("step", F.greatest(F.col("room") - largest, F.lit(1)))
    # a long turn takes two steps of the line and stands in their middle: alone in its span
    width = F.when(F.col("is_system"), 0).when(F.col("long"), 2 * F.col("step")).otherwise(F.col("tokens"))
    before = F.sum(width).over(conv.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - width
    turns = turns.withColumn("span", F.floor((before + F.when(F.col("long"), F.col("step")).otherwise(0)) / F.col("step")))
    rest = F.sum("tokens").over(Window.partitionBy("conv_id", "span").orderBy(F.desc("n")))
    follows = conv.orderBy(F.desc("span")).rangeBetween(Window.unboundedPreceding, -1)
    next_long = F.max(F.struct(-F.col("span"), F.col("long"))).over(follows)
    turns = turns.withColumns({"rest": rest, "next": F.min("span").over(follows), "next_long": next_long["long"]})
    again = F.col("next").isNotNull() & ~F.col("is_system") & (F.col("rest") <= history) & ~F.col("next_long")
    placed = turns.select("conv_id", "n", "role", "tokens", "is_system", "shown", "body", F.explode(
        F.when(again, F.array(F.struct(F.col("span").alias("window"), F.lit(False).alias("again")),
                              F.struct(F.col("next").alias("window"), F.lit(True).alias("again"))))
        .otherwise(F.array(F.struct(F.col("span").alias("window"), F.lit(False).alias("again"))))).alias("at"))
    placed = placed.select("*", "at.window", "at.again").drop("at").withColumn(
        "shown_chars", F.length("shown") + F.length("body") + len(CLOSE) + 1)
    inside = Window.partitionBy("conv_id", "window").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("start", F.sum("shown_chars").over(inside) - F.col("shown_chars"))
    target = (F.col("role") == "assistant") & ~F.col("again")
    windows = placed.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("n", F.concat("shown", "body", F.lit(CLOSE + "\n")).alias("x")))).alias("parts"),
        F.array_sort(F.collect_list(F.when(target, F.struct(
            (F.col("start") + F.length("shown")).cast("long").alias("start"),
            F.length("body").cast("long").alias("length"))))).alias("loss"),
        F.sum(F.col("again").cast("int")).alias("repeated"), F.sum((~F.col("again")).cast("int")).alias("n_turns"),
        F.sum("tokens").alias("n_tokens"), F.max("is_system").alias("has_system"))
    system = turns.where("is_system").select(
        F.col("conv_id").alias("_conv"), F.concat("shown", "body", F.lit(CLOSE + "\n")).alias("system"),
        F.col("tokens").alias("system_tokens"))
    windows = windows.join(system, windows["conv_id"].eqNullSafe(system["_conv"]), "left")
    lead = F.when(~F.col("has_system"), F.col("system"))
    shift = F.coalesce(F.length(lead), F.lit(0)).cast("long")
    n_tokens = F.col("n_tokens") + F.when(lead.isNotNull(), F.col("system_tokens")).otherwise(0)
    return windows.select(
        "conv_id", "window",
        F.concat(F.coalesce(lead, F.lit("")), F.array_join(F.transform("parts", lambda p: p["x"]), "")).alias("text"),
        (F.col("repeated") + lead.isNotNull().cast("int")).alias("repeated"), "n_turns", n_tokens.alias("n_tokens"),
        (n_tokens > budget).alias("over_budget"),
        F.transform("loss", lambda s: F.struct((s["start"] + shift).alias("start"), s["length"].alias("length"))).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from formatted windows alone: n_turns, turns (each turn's role, newline,
    text, newline, in order) and loss_text (what the loss masks cover, unescaped), formatted_chars."""
    pieces = F.split("text", r"<\|im_start\|>", -1)  # the first piece is empty
    shown = F.slice(pieces, F.col("repeated") + 2, F.size(pieces) - F.col("repeated") - 1)
    role = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substring(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - 2 - len(CLOSE))
    turns = F.transform(shown, lambda x: F.concat(_unescape_role(role(x)), F.lit("\n"), unescape(body(x)), F.lit("\n")))
    covered = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    parts = windows.select("conv_id", "window", F.size(shown).alias("n_turns"), F.array_join(turns, "").alias("turns"),
                           F.array_join(covered, "").alias("loss_text"), F.length("text").alias("chars"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n_turns").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns",
                        F.array_join(F.transform("parts", lambda p: p["turns"]), "").alias("turns"),
                        F.array_join(F.transform("parts", lambda p: p["loss_text"]), "").alias("loss_text"),
                        "formatted_chars")
