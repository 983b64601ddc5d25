"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as named users; only the assistant's words carry loss. A rendered dialogue is a table of its turns with
their places in the text, so a conversation of any length is never gathered into one row or one task; ``dialogues``
joins the turns of conversations that are known to be short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns of a slice, within which places are summed in order.
SLICE = 1024


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per perspective and turn: conv_id, assistant, turn, speaker, head, body, tail, loss, rendered.

    Rows that repeat a conversation's turn, speaker and text count once. A null speaker is called ``unknown``, a
    null text is empty, a null conversation or turn is a value like others. An empty table gives no rows; other
    columns are not read."""
    said = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("body")).distinct()
    who = (turns.select(F.col(conv_col).alias("c"), F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("assistant")).distinct())
    both = said.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    loss = F.col("speaker") == F.col("assistant")
    head = F.concat(F.lit(OPEN), F.when(loss, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), "speaker")), F.lit("\n"))
    return (both.select("conv_id", "assistant", "turn", "speaker", head.alias("head"), "body", F.lit(CLOSE).alias("tail"), loss.alias("loss"))
            .withColumn("rendered", F.concat("head", "body", "tail")))


def placed(rotated: DataFrame) -> DataFrame:
    """Add each turn's start and length in its dialogue (code points) and the masked span of the assistant's words.
    Turns are summed by slices of turn numbers first, so a long conversation is spread over many tasks."""
    keys = ["conv_id", "assistant"]
    cut = rotated.withColumn("slice", F.floor(F.col("turn") / SLICE)).withColumn("length", F.length("rendered"))
    order = [F.col("turn").asc_nulls_first(), "speaker", "body"]
    within = F.sum("length").over(Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = cut.groupBy(*keys, "slice").agg(F.sum("length").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = sums.select(*[F.col(k).alias(f"{k}_") for k in [*keys, "slice"]], before.alias("before"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in [*keys, "slice"]]
    out = cut.withColumn("within", within).join(starts, same[0] & same[1] & same[2])
    start = F.col("before") + F.col("within") - F.col("length")
    mask = F.when(F.col("loss"), F.struct((start + F.length("head")).alias("start"), (start + F.length("head") + F.length("body")).alias("end")))
    return out.select("conv_id", "assistant", "turn", "speaker", "rendered", "loss", start.alias("start"), "length", mask.alias("mask"))


def dialogues(rotated: DataFrame) -> DataFrame:
    """One row per conversation and perspective with the whole text: for conversations known to fit one row."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "speaker", "body", "rendered")))
    return rotated.groupBy("conv_id", "assistant").agg(F.array_join(F.transform(parts, lambda x: x["rendered"]), "").alias("text"))
