"""Perspective rotation of multi-party conversations, with DataFrame functions only.

Every distinct role of a conversation is a participant. For each of them the
whole dialogue is rendered with that speaker as the assistant and the others as
named users, and the assistant's words are marked by a mask: code point ranges
of the rendered text on which a model would be trained.

A conversation of any length is rendered in parts: the turns whose number, divided
by ``PART``, has the same quotient. The parts of one perspective, joined in order
of ``part``, are the whole dialogue, and ``starts_at`` gives where a part begins
in it. So no task gathers more than a part's turns, and only lengths of parts
are summed along a conversation.

Markers in a role or a text (``<|`` and ``|>``) are written with a backslash between their
characters, so nobody's words can open or close a turn; lengths and masks are those of what
is written. ``speaker`` is the role as given.

Defined cases: a null role speaks as ``unknown``; a null text is empty; turns are
ordered by number, then by role and text, so repeated turns stay and ties have
one order; a null turn number makes a part of its own before the others; a null
conv_id is a conversation; texts of any length are rendered whole; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 64
UNKNOWN = "unknown"
FIRST = -(2**62)  # the part of turns without a number


def escaped(text: Column) -> Column:
    """Without markers of turns."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, speaker, part, n_turns, starts_at, rendered, mask, n_masked.

    ``mask`` lists ``start-end`` ranges within the part, end excluded.
    """
    own_head, other_head = "<|assistant|>\n", F.concat(F.lit("<|user name="), escaped(F.col("role")), F.lit("|>\n"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    turns = turns.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn(
        "part", F.coalesce(F.floor(F.col("turn") / part).cast("long"), F.lit(FIRST))
    )

    # Lengths alone: what each part takes in each perspective, and where it starts.
    said = turns.groupBy("conv", "part", "role").agg(
        F.count("*").alias("n"),
        F.sum(F.length("text") + F.length(other_head) + 1).alias("size"),
        F.first(F.length(other_head)).alias("head"),
    )
    sizes = said.groupBy("conv", "part").agg(F.sum("size").alias("size"))
    speakers = said.select("conv", F.col("role").alias("speaker")).distinct()
    own = said.select("conv", "part", F.col("role").alias("speaker"), (F.col("n") * (len(own_head) - F.col("head"))).alias("change"))
    before = Window.partitionBy("conv", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.join(speakers, "conv")
        .join(own, ["conv", "part", "speaker"], "left")
        .select(
            "conv",
            "part",
            "speaker",
            F.coalesce(F.sum(F.col("size") + F.coalesce("change", F.lit(0))).over(before), F.lit(0)).alias("starts_at"),
        )
        .groupBy("conv", "part")
        .agg(F.collect_list(F.struct("speaker", "starts_at")).alias("views"))
    )

    # Texts travel once, to their part.
    parts = turns.groupBy("conv_id", "conv", "part").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    whole = parts.join(starts, ["conv", "part"]).select("*", F.inline("views")).drop("views")
    mine = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.when(mine(t), own_head).otherwise(
        F.concat(F.lit("<|user name="), escaped(t["role"]), F.lit("|>\n"))
    )
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda done, t: F.struct(
            (done["at"] + F.length(head(t)) + F.length(t["text"]) + 1).alias("at"),
            F.when(
                mine(t),
                F.array_append(
                    done["spans"],
                    F.struct(
                        (done["at"] + len(own_head)).alias("start"),
                        (done["at"] + len(own_head) + F.length(t["text"])).alias("stop"),
                    ),
                ),
            )
            .otherwise(done["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return whole.withColumn("spans", spans).select(
        "conv_id",
        "speaker",
        F.when(F.col("part") > FIRST, F.col("part")).alias("part"),
        F.size("turns").cast("long").alias("n_turns"),
        F.col("starts_at").cast("long").alias("starts_at"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(
            F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))),
            ",",
        ).alias("mask"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_masked"),
    )
