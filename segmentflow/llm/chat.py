r"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

Prefix sums of estimated turn tokens give each conversation's spans: a window takes new turns while
they fit the budget left by the system turn and the repeated history.  A later window starts with
the system turn and as many preceding turns as fit the history allowance; these repeats carry no
loss.  ``loss_spans`` marks (code points, end exclusive) the assistant texts that are new.

Escapes: ``\`` becomes ``\b``, ``<|`` becomes ``<\p`` and, in roles, a line break becomes ``\l``;
undone in the order l, p, b.  Markers thus never occur inside a text.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), then role,
then text, so ties and repeated rows keep a fixed order and each counts as a turn.  A turn above the
budget gets a window of its own.  A null conversation id is a conversation.  No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.llm.columns import column

START, END = "<|im_start|>", "<|im_end|>"
TAIL = END + "\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\l"), F.lit("\n")))


def estimated_tokens(text: Column) -> Column:
    """A turn's tokens: one for four code points, and four for its markers."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def format_windows(
    turns: DataFrame,
    budget: int = 1024,
    history: int = 192,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows (conv_id, window_no, formatted, repeated_turns, loss_spans) for each conversation."""
    order = Window.partitionBy("conv_key").orderBy("turn_key", "role", "text")
    rows = (
        turns.select(
            column(conv_col).alias("conv_key"),
            column(turn_col).alias("turn_key"),
            F.coalesce(column(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"),
        )
        .withColumn("tokens", estimated_tokens(F.col("text")))
        .withColumn("no", F.row_number().over(order))
        .withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("upto") - F.col("tokens"))
    )
    # The earliest turn from which the repeated history still fits, by a range over the prefix sums.
    reach = Window.partitionBy("conv_key").orderBy("before").rangeBetween(-history, 0)
    rows = rows.withColumn("back_to", F.min("no").over(reach))
    shown = rows.select(
        "conv_key",
        "no",
        "before",
        "upto",
        "back_to",
        "tokens",
        (F.col("role") == "system").alias("is_system"),
        (F.col("role") == "assistant").alias("is_target"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    turn = F.struct("no", "before", "upto", "back_to", "tokens", "is_system", "is_target", "head", "body")
    talks = shown.groupBy("conv_key").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    kept = F.when(F.col("turns")[0]["is_system"], 1).otherwise(0)
    talks = talks.withColumn("kept", kept).withColumn(
        "room",
        F.greatest(
            F.lit(1), F.lit(budget - history) - F.when(F.col("kept") == 1, F.col("turns")[0]["tokens"]).otherwise(0)
        ).cast("long"),
    )
    # Greedy spans over the prefix sums: a turn that no longer fits opens the next window.
    zero = F.struct(F.array(F.lit(1)).alias("cuts"), F.lit(0).cast("long").alias("base"))

    def step(state: Column, t: Column) -> Column:
        opens = (t["upto"] - state["base"] > F.col("room")) & (t["no"] > state["cuts"][F.size(state["cuts"]) - 1])
        opens = opens & (t["no"] > F.col("kept") + 1)
        return F.struct(
            F.when(opens, F.concat(state["cuts"], F.array(t["no"]))).otherwise(state["cuts"]).alias("cuts"),
            F.when(opens, t["before"])
            .when(t["no"] <= F.col("kept"), t["upto"])
            .otherwise(state["base"])
            .alias("base"),
        )

    talks = talks.withColumn("cuts", F.aggregate("turns", zero, step)["cuts"])
    cuts, all_turns = F.col("cuts"), F.col("turns")

    def window(cut: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at(cuts, k + 2), F.size(all_turns) + 1)
        first = F.when(k == 0, cut).otherwise(F.greatest(all_turns[cut - 1]["back_to"], F.col("kept") + 1))
        system = F.when(k > 0, F.slice(all_turns, 1, F.col("kept"))).otherwise(F.slice(all_turns, 1, 0))
        return F.struct(
            k.alias("window_no"),
            F.concat(system, F.slice(all_turns, first, end - first)).alias("shown"),
            (F.size(system) + cut - first).alias("repeated_turns"),
        )

    windows = talks.select("conv_key", F.explode(F.transform("cuts", window)).alias("w")).select(
        "conv_key", "w.window_no", "w.shown", "w.repeated_turns"
    )

    def locate(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        return F.struct(
            (end + len(TAIL)).alias("at"),
            (state["seen"] + 1).alias("seen"),
            F.when(
                t["is_target"] & (state["seen"] >= F.col("repeated_turns")),
                F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        )

    empty = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("seen"), F.expr("array()").cast("array<struct<start:int,end:int>>").alias("spans")
    )
    return windows.select(
        F.col("conv_key").alias(conv_col),
        "window_no",
        F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "").alias("formatted"),
        "repeated_turns",
        F.aggregate("shown", empty, locate)["spans"].alias("loss_spans"),
    )


def read_windows(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read back (conv_id, turns, loss_texts, formatted_chars) from formatted windows alone."""
    parts = F.split("formatted", r"<\|im_start\|>", -1)
    bodies = F.slice(parts, F.col("repeated_turns") + 2, F.size(parts))

    def parse(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.length(part) - len(TAIL))
        role = F.substring_index(body, "\n", 1)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"),
        )

    read = windows.select(
        column(conv_col).alias("conv_key"),
        "window_no",
        F.transform(bodies, parse).alias("turns"),
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])),
        ).alias("loss_texts"),
        F.length("formatted").cast("long").alias("chars"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("window_no", "turns", "loss_texts")))
    return (
        read.groupBy("conv_key")
        .agg(ordered.alias("w"), F.sum("chars").alias("formatted_chars"))
        .select(
            F.col("conv_key").alias(conv_col),
            F.flatten("w.turns").alias("turns"),
            F.flatten("w.loss_texts").alias("loss_texts"),
            "formatted_chars",
        )
    )
