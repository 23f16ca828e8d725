"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as <|role|>text</s>. In roles and texts ~ becomes ~0, < becomes ~1, [ becomes ~2 and | becomes ~3,
so that no control string (</s>, <|, [INST], ...) of a text survives, and all of it can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))
OPEN, CLOSE, END = "<|", "|>", "</s>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """Estimated tokens of a turn: one for each four characters, and four for its marks."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def windows(turns: DataFrame, budget: int = 2048, history_turns: int = 2, history_tokens: int = 256) -> DataFrame:
    """conv_id, window (from 0), formatted, n_repeated, loss for every conversation of turns(conv_id, turn, role, text).

    Prefix sums of the turns' tokens cut a conversation, turn by turn, into spans that fit in the budget beside a
    leading system turn and the history; a turn that is larger stands alone, uncut. A later window repeats the system
    turn and up to history_turns turns before its span, as far as they have at most history_tokens tokens: these are
    its n_repeated first turns. loss holds the start and end (characters of formatted, end exclusive) of the
    assistant texts that are not repeated.

    Turns go by turn, then role and text, with null first; a null role or text is empty; rows that repeat a turn are
    turns of their own; rows of null conv_id are one conversation; an empty table gives an empty one; other columns
    are not read. A conversation is gathered in one row, as its digest and its order ask for; conversations are
    spread over tasks.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), tokens(text).alias("n"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    lead = F.when(F.element_at("turns", 1)["role"] == "system", 1).otherwise(0)
    whole = whole.withColumn("lead", lead)
    room = budget - history_tokens - F.when(F.col("lead") == 1, F.element_at("turns", 1)["n"]).otherwise(F.lit(0))
    # starts: where spans begin, from 1. Only a new span adds to the array.
    first = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("used"), F.array(F.lit(1).cast("long")).alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        system = (acc["i"] == 0) & (F.col("lead") == 1)
        more = F.when(system, F.lit(0).cast("long")).otherwise(x["n"])
        full = (acc["used"] > 0) & (acc["used"] + more > F.col("room"))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, more).otherwise(acc["used"] + more).alias("used"),
            F.when(full, F.concat(acc["starts"], F.array(acc["i"] + 1))).otherwise(acc["starts"]).alias("starts"),
        )

    whole = whole.withColumn("room", room.cast("long")).withColumn("starts", F.aggregate("turns", first, step, lambda acc: acc["starts"]))

    def span(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("starts", i + 1), F.size("turns").cast("long") + 1)
        from_ = F.greatest(F.col("lead").cast("long") + 1, start - history_turns)
        before = F.slice("turns", from_.cast("int"), F.greatest(F.lit(0), start - from_).cast("int"))
        # suffix sums over at most history_turns turns
        fits = F.filter(before, lambda t, j: F.aggregate(F.slice(before, j + 1, history_turns), F.lit(0).cast("long"), lambda a, u: a + u["n"]) <= history_tokens)
        system = F.slice("turns", 1, F.col("lead"))
        repeated = F.when(start == 1, F.slice("turns", 1, 0)).otherwise(F.concat(system, fits))
        return F.struct(i.alias("window"), repeated.alias("repeated"), F.slice("turns", start.cast("int"), (end - start).cast("int")).alias("fresh"))

    cut = whole.select("conv_id", F.explode(F.transform("starts", span)).alias("w")).select("conv_id", "w.*")
    write = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE), escape(t["text"]), F.lit(END))
    lines = cut.select("conv_id", "window", F.size("repeated").alias("n_repeated"), F.transform(F.concat("repeated", "fresh"), lambda t: F.struct(t["role"].alias("role"), write(t).alias("line"), F.length(escape(t["text"])).alias("n"))).alias("lines"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def mark(acc: Column, x: Column) -> Column:
        end = acc["end"] + F.length(x["line"])
        own = F.struct((end - x["n"] - len(END)).alias("start"), (end - len(END)).alias("end"))
        counts = (acc["i"] >= F.col("n_repeated")) & (x["role"] == "assistant")
        return F.struct((acc["i"] + 1).alias("i"), end.alias("end"), F.when(counts, F.concat(acc["loss"], F.array(own))).otherwise(acc["loss"]).alias("loss"))

    return lines.select("conv_id", "window", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("formatted"), "n_repeated", F.aggregate("lines", start, mark, lambda acc: acc["loss"]).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; in order, each once), loss_text, formatted_chars from the rows of windows()."""
    parts = F.split("formatted", END)
    parts = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(parts) - 1 - F.col("n_repeated")))

    def read(part: Column) -> Column:
        at = F.instr(part, CLOSE)
        return F.struct(unescape(F.substring(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescape(F.substring(part, at + len(CLOSE), F.length(part))).alias("text"))

    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    own = formatted.select("conv_id", F.struct("window", F.transform(parts, read).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("n")).alias("w"))
    by = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    return by.select(
        "conv_id",
        F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["loss"]), "").alias("loss_text"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["n"]).alias("formatted_chars"),
    )
