"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a newline. Inside roles and texts the signs that
templates are made of are written as a backslash and a letter, so no text can open or close a turn, and
reading back is exact.

Long conversations become several windows. Prefix sums of the turns' tokens give every turn its start;
the tokens are cut into stretches of half the room that the budget leaves, and a span is the turns that
start in one stretch. A turn longer than half the room is a span of its own. A span of several turns thus never
exceeds the room; a single turn is never cut, however long. Every window after the first repeats
the system turn and those turns before its span that fit a limited history. Only the assistant's texts
of the span itself are targets: repeated ones are masked, so each is a target once.

A conversation is one group: the prefix sums need its turns in order. Texts are tokens for the budget
by their words; three more stand for the marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 512, 96
MARKS = 3
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: How signs of the template are written inside texts; the backslash comes first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escaped(text: Column) -> Column:
    for plain, mark in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def chat_windows(
    df: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    conversation_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """A row per window: conversation, ``window`` from 0, ``text``, ``targets`` (start from 0 and length in
    code points of every target in ``text``), ``repeated`` (turns at the beginning that an earlier window has
    too) and ``tokens``.

    Turns come by turn number, then role, then text, NULL numbers last. NULL roles and texts are empty; rows with a
    NULL conversation are one conversation; repeated rows are turns of their own. The system turn is
    a first turn of role ``system``; if it leaves less than a quarter of the budget, the room is that quarter.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = df.select(
        F.col(conversation_column).alias("conv"),
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("said"),
    )
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))
    rows = rows.select(
        "*",
        F.concat(head, escaped(F.col("said")), F.lit(CLOSE)).alias("segment"),
        F.char_length(head).alias("head"),
        F.char_length(escaped(F.col("said"))).alias("chars"),
        (F.regexp_count("said", F.lit(r"[^\x20\x09-\x0D]+")) + MARKS).cast("long").alias("tokens"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_last("turn"), "role", "said")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("at", F.row_number().over(order))
        .withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
        .withColumn("counted", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
        .withColumn("start", F.sum("counted").over(so_far) - F.col("counted"))
        .withColumn("place", F.coalesce(F.sum(F.char_length("segment")).over(before), F.lit(0)))
        .withColumn("opening", F.first(F.when(F.col("system"), F.struct("segment", "tokens"))).over(so_far))
        .withColumn("room", F.greatest(F.lit(budget - history) - F.coalesce("opening.tokens", F.lit(0)), F.lit(budget // 4)))
        .withColumn("stretch", F.floor(F.col("start") * 2 / F.col("room")))
        .withColumn("long", F.col("counted") * 2 > F.col("room"))
        .withColumn(
            "first",
            (F.col("at") == 1)
            | ~F.lag("system").over(order) & ((F.col("stretch") != F.lag("stretch").over(order)) | F.col("long") | F.lag("long").over(order)),
        )
        .withColumn("window", F.sum(F.col("first").cast("int")).over(so_far) - 1)
    )
    near = Window.partitionBy("conv").orderBy("start").rangeBetween(-history, -1)
    rows = rows.withColumn("past", F.collect_list(F.when(~F.col("system"), F.struct("start", "at", "segment", "tokens"))).over(near))
    later = F.col("first") & (F.col("window") > 0)
    past = F.array_sort("past")
    rows = rows.withColumn(
        "lead",
        F.when(
            later,
            F.struct(
                F.concat(F.coalesce("opening.segment", F.lit("")), F.array_join(F.transform(past, lambda x: x["segment"]), "")).alias("text"),
                (F.size("past") + F.col("opening").isNotNull().cast("int")).alias("turns"),
                (F.coalesce("opening.tokens", F.lit(0)) + F.aggregate("past", F.lit(0).cast("long"), lambda s, x: s + x["tokens"])).alias("tokens"),
            ),
        ),
    )
    turns = F.array_sort(F.collect_list(F.struct("at", "segment", "role", "place", "head", "chars")))
    grouped = rows.groupBy("conv", "window").agg(turns.alias("turns"), F.max("lead").alias("lead"), F.sum("tokens").alias("tokens"))
    ahead = F.coalesce(F.char_length("lead.text"), F.lit(0)).cast("long")
    targets = F.transform(
        F.filter("turns", lambda x: x["role"] == "assistant"),
        lambda x: F.struct(
            (ahead + x["place"] - F.col("turns")[0]["place"] + x["head"]).alias("start"), x["chars"].cast("long").alias("length")
        ),
    )
    return grouped.select(
        F.col("conv").alias(conversation_column),
        F.col("window").cast("int").alias("window"),
        F.concat(F.coalesce("lead.text", F.lit("")), F.array_join(F.transform("turns", lambda x: x["segment"]), "")).alias("text"),
        targets.alias("targets"),
        F.coalesce("lead.turns", F.lit(0)).alias("repeated"),
        (F.col("tokens") + F.coalesce("lead.tokens", F.lit(0))).alias("tokens"),
    )


def conversations_of(windows: DataFrame, conversation_column: str = "conv_id") -> DataFrame:
    """Conversations read back from their windows: ``turns`` (role, text), ``targets`` (texts) and
    ``formatted_chars``."""
    segments = F.split("text", CLOSE)  # ends with an empty part
    own = F.slice(segments, F.col("repeated") + 1, F.size(segments) - 1 - F.col("repeated"))
    bare = lambda x: F.substring(x, len(OPEN) + 1, 1 << 30)
    turns = F.transform(
        own,
        lambda x: F.struct(
            unescaped(F.substring_index(bare(x), MIDDLE, 1)).alias("role"),
            unescaped(F.substring(bare(x), F.char_length(F.substring_index(bare(x), MIDDLE, 1)) + len(MIDDLE) + 1, F.lit(1 << 30))).alias("text"),
        ),
    )
    targets = F.transform("targets", lambda x: unescaped(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    parts = windows.select(conversation_column, "window", turns.alias("turns"), targets.alias("targets"), F.char_length("text").alias("chars"))
    whole = parts.groupBy(conversation_column).agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("parts"), F.sum("chars").alias("formatted_chars")
    )
    return whole.select(
        conversation_column,
        F.flatten("parts.turns").alias("turns"),
        F.flatten("parts.targets").alias("targets"),
        "formatted_chars",
    )


def digests(conversations: DataFrame, conversation_column: str = "conv_id") -> DataFrame:
    """Counts and digests of conversations as ``conversations_of`` gives them."""
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return conversations.select(
        conversation_column,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(F.array_join("targets", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("targets", "").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
