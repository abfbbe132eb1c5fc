"""Turns of conversations dealt over blocks in their order, so that one conversation is shared among tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import NONE, small, written

#: Values of ``turn`` that one block spans.
BLOCK = 1024
#: The order of turns; rows equal in all of these are equal but for a clash of hashes. Nulls come first.
ORDER = ["conv_id", "block", "sub", "turn", "role", "tie"]


def dealt(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, tie, ...) with ``block`` and ``sub``, by which a conversation's rows are in the order of turn (nulls first), role and tie (a hash of the text).

    ``sub`` is empty unless a block has more than four rows a turn it spans; then it is made of turn, role and as many leading bits of ``tie`` as part the block.
    """
    x = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(NONE)))
    full = x.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * BLOCK)
    full = written(full.select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / BLOCK))).cast("int").alias("__bits")))
    if not full.limit(1).count():
        return x.withColumn("sub", F.lit(""))
    x = x.join(small(full, 100_000), x["conv_id"].eqNullSafe(F.col("__c")) & (x["block"] == F.col("__b")), "left")
    turn = F.coalesce(F.lpad((F.col("turn") - F.col("block") * BLOCK).cast("string"), 4, "0"), F.lit(""))
    role = F.coalesce(F.concat(F.lit("\x01"), "role"), F.lit(""))
    piece = F.lpad(F.expr("hex(shiftright(tie, 64 - __bits) + shiftleft(1L, __bits - 1))"), 16, "0")
    return x.withColumn("sub", F.when(F.col("__bits").isNull(), "").otherwise(F.concat_ws("\x00", turn, role, piece))).drop("__c", "__b", "__bits")


def numbered(rows: DataFrame) -> DataFrame:
    """rows of ``dealt``, written, with ``pos``, their place in the conversation from 0. A window runs inside each block, and one over the rows' counts by block."""
    rows = written(rows)
    per = rows.groupBy("conv_id", "block", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1))
    per = written(per.withColumn("__before", before).where("__before > 0").drop("n"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "block", "sub").orderBy("turn", "role", "tie")) - 1
    x = rows.withColumn("__in", inside).join(small(per, 100_000), ["conv_id", "block", "sub"], "left")
    return written(x.withColumn("pos", (F.col("__in") + F.coalesce("__before", F.lit(0))).cast("long")).drop("__in", "__before", "block", "sub"))
