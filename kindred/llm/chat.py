"""Chat formatting: every participant's view of a dialogue, with the parts to learn from marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of one part of a rendered dialogue.
PART_TURNS = 256


def escaped(text: Column) -> Column:
    """Text in which no marker can stand: a backslash is doubled and one is put into each "<|"."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, system: str = "system") -> DataFrame:
    """(conv_id, speaker, part, n_turns, n_own, rendered, begin, n_chars, mask), a row per conversation, participant and part.

    For each participant, the dialogue with this speaker as assistant and the others as users with their names; system
    turns stay system turns and are nobody's view. A dialogue of any length is one text, which is given in parts so that
    no task holds all of it: a part has the turns of part_turns consecutive turn numbers (null turns: part -1), in order
    of turn, role and text, and begins at code point `begin` of the whole. mask lists [start, end) in code points of the
    whole, as "start-end,...", of the assistant's contents and their end markers: what is learned from. whole() puts the
    parts together. A speaker also gets the parts in which it is silent. A null role is the participant "unknown", a
    null text is empty; repeated rows stay; a null conv_id is a conversation; one of system turns only has no view. An
    empty table gives an empty result; other columns are not read.
    """
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    mine, other = F.lit("<|assistant|>\n"), lambda role: F.when(role == system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), escaped(role), F.lit("|>\n")))
    body = lambda text: F.concat(escaped(text), F.lit("<|end|>\n"))
    #: Lengths by conversation, part and role tell where each part begins in each view, without its texts.
    sizes = rows.groupBy("conv_id", "part", "role").agg(F.count(F.lit(1)).alias("own"), F.sum((F.length(body(F.col("text"))) + F.length(other(F.col("role")))).cast("long")).alias("chars"))
    every = sizes.groupBy("conv_id", "part").agg(F.sum("chars").alias("chars"))
    speakers = sizes.where(F.col("role") != system).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    views = every.join(speakers, _same(F.col("conv_id"), F.col("_conv"))).drop("_conv")
    owns = sizes.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("role").alias("_role"), "own")
    views = views.join(owns, _same(F.col("conv_id"), F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("speaker") == F.col("_role")), "left")
    views = views.withColumn("chars", F.col("chars") + F.coalesce("own", F.lit(0)) * (F.length(mine) - F.length(other(F.col("speaker")))))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    views = views.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "speaker", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("begin"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    shown = parts.join(views, _same(F.col("conv_id"), F.col("_conv")) & (F.col("part") == F.col("_part")))
    head = lambda t: F.when(t["role"] == F.col("speaker"), mine).otherwise(other(t["role"]))
    said = F.transform("turns", lambda t: F.struct(head(t).alias("head"), body(t["text"]).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    start = F.struct(F.col("begin").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    shown = shown.withColumn("said", said).withColumn("walk", F.aggregate("said", start, step))
    return shown.select(
        "conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), F.size("walk.spans").cast("long").alias("n_own"),
        F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"])), "").alias("rendered"), "begin", (F.col("walk.at") - F.col("begin")).alias("n_chars"), F.array_join("walk.spans", ",").alias("mask"),
    )


def whole(views: DataFrame) -> DataFrame:
    """(conv_id, speaker, rendered, mask) of rotate()'s rows: each view as one text. A text must fit into a task here."""
    parts = F.sort_array(F.collect_list(F.struct("part", "rendered", "mask")))
    joined = views.groupBy("conv_id", "speaker").agg(parts.alias("p"))
    return joined.select("conv_id", "speaker", F.array_join("p.rendered", "").alias("rendered"), F.array_join(F.filter("p.mask", lambda m: m != ""), ",").alias("mask"))
