"""Chat formatting with Spark expressions only (operator 8).

Turns are gathered per conversation as structs and sorted, runs of the same role become one
message, and everything is concatenated. No Python runs on the executors.

Template: `<|im_start|>role\\n` text `<|im_end|>\\n` per message; texts of turns that were merged
stand in one message with `<|im_sep|>` between them, so that nothing is lost. In roles and
texts `\\` becomes `\\\\` and `<|` becomes `<\\|` (in roles a line feed becomes `<|nl|>`), so a text can
hold any control string and be read back exactly.

Defined results: a null text or role is empty; rows with the same turn number stand in the
order of role and text; rows with a null conv_id form one conversation; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEPARATOR, LINE_FEED = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text begins a pair, whose second character is meant."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE_FEED))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE_FEED), F.lit("\n")))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and segments: consecutive parts of `formatted` and whether the loss covers them."""
    rows = turns.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("ts")),
        lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    with_runs = sorted_turns.withColumn("starts", starts).withColumn("stops", F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("ts") + 1)))
    messages = F.transform(
        F.arrays_zip("starts", "stops"),
        lambda z: F.struct(
            F.element_at("ts", z["starts"])["role"].alias("role"),
            F.transform(F.slice("ts", z["starts"], z["stops"] - z["starts"]), lambda t: escape(t["text"])).alias("texts"),
        ),
    )

    def parts(message: Column) -> Column:
        covered = message["role"] == trained_role
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        texts = F.flatten(F.transform(message["texts"], lambda t, i: F.array(part(F.when(i == 0, F.lit("")).otherwise(F.lit(SEPARATOR)), F.lit(False)), part(t, covered))))
        head = part(F.concat(F.lit(START), escape_role(message["role"]), F.lit("\n")), F.lit(False))
        return F.concat(F.array(head), texts, F.array(part(F.lit(f"{END}\n"), F.lit(False))))

    formatted = with_runs.withColumn("messages", messages).select("conv_id", F.filter(F.flatten(F.transform("messages", parts)), lambda p: p["text"] != "").alias("segments"))
    return formatted.select("conv_id", F.array_join(F.transform("segments", lambda p: p["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of structs of role and text."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    messages = F.slice(pieces, F.lit(2), F.size(pieces))
    role = lambda m: unescape_role(F.substring_index(m, "\n", 1))
    body = lambda m: F.substr(m, F.instr(m, "\n") + 1)
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                F.split(F.substring_index(body(m), END, 1), r"<\|im_sep\|>"),
                lambda t: F.struct(role(m).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def digest(turns: DataFrame) -> DataFrame:
    """What a reader of the formatted text finds: counts and hashes per conversation."""
    out = format_conversations(turns)
    told = out.withColumn("back", read_back(F.col("formatted"))).withColumn("covered", F.array_join(F.transform(F.filter("segments", lambda p: p["loss"]), lambda p: unescape(p["text"])), ""))
    rows = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(rows, 256).alias("turns_sha256"),
        F.length("covered").cast("long").alias("loss_chars"),
        F.sha2(F.col("covered"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
