"""Perspective rotation of multi-party dialogues, in DataFrame operations only.

Every speaker of a dialogue gets a view of it: the own turns are the assistant's and are trained on,
the others' are those of named users. A view is laid out as rendered messages with their places in the
rendered text, or as shards of that text with the spans of the mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import keep

#: Roles that instruct and never speak for themselves.
SYSTEM_ROLES = ("system",)


def speaker_of(role: Column) -> Column:
    """The trimmed role; null and blank are one speaker named ``unknown``."""
    name = F.trim(F.coalesce(role, F.lit("")))
    return F.when(name == "", "unknown").otherwise(name)


def _with_start(views: DataFrame) -> DataFrame:
    """``start``: characters of the view before the message, by sums in two levels.

    The rows are sorted over all partitions, so a dialogue of any length is spread over many tasks. A
    row's start is the sum before it in its partition plus what earlier partitions hold of its view, of
    which each partition contributes one row for the view that it ends with.
    """
    order = ["conv_id", "perspective", "turn", "speaker", "content"]
    rows = views.withColumn("_size", F.length("rendered").cast("long"))
    ordered = keep(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "chat-views")
    view = [F.col("conv_id"), F.col("perspective")]
    totals = ordered.groupBy("_part", *view).agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*view).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_part", *view,
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
    )
    inside = Window.partitionBy("_part", *view).orderBy("turn", "speaker", "content").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumns(
        {"_inner": F.coalesce(F.sum("_size").over(inside), F.lit(0)), "_index": F.count(F.lit(1)).over(inside)}
    )
    same = (placed["_part"] == carried["_part"]) & placed["conv_id"].eqNullSafe(carried["conv_id"]) & (placed["perspective"] == carried["perspective"])
    return placed.join(carried, same).select(
        *[placed[c] for c in views.columns],
        (F.col("_inner") + F.col("_carry")).alias("start"),
        (F.col("_index") + F.col("_rows_before")).alias("position"),
        placed["_size"].alias("size"),
    )


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message of each view: ``conv_id, perspective, position, turn, speaker, role, name,
    rendered, start, text_start, text_end, trained``.

    ``start`` and the span ``text_start`` to ``text_end`` count code points of the view's rendered text;
    ``trained`` marks the messages of the perspective's speaker, whose span is the mask. Messages follow
    ``turn``; ties follow speaker and text, nulls come first. System turns stay as they are in every view
    and make no view; a dialogue with nothing else gives no rows. Null text is empty. A null ``conv_id``
    is one dialogue; repeated rows are messages of their own. Other columns are not read.
    """
    rows = turns.select(
        turns[conv].alias("conv_id"), turns[turn].alias("turn"),
        speaker_of(turns[role]).alias("speaker"), F.coalesce(turns[text], F.lit("")).alias("content"),
    )
    is_system = F.col("speaker").isin(*SYSTEM_ROLES)
    speakers = rows.where(~is_system).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    views = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    shown = F.when(is_system, "system").when(own, "assistant").otherwise("user")
    name = F.when(~is_system & ~own, F.col("speaker"))
    head = F.concat(F.lit("<|im_start|>"), shown, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    views = views.withColumns({"role": shown, "name": name, "trained": own, "_head": F.length(head)})
    views = views.withColumn("rendered", F.concat(head, "content", F.lit("<|im_end|>\n")))
    placed = _with_start(views)
    return placed.select(
        "conv_id", "perspective", "position", "turn", "speaker", "role", "name", "rendered", "start",
        (F.col("start") + F.col("_head")).alias("text_start"),
        (F.col("start") + F.col("_head") + F.length("content")).alias("text_end"),
        "trained",
    )


def shards(messages: DataFrame, size: int = 65_536) -> DataFrame:
    """Rendered text by view in shards: ``conv_id, perspective, shard, start, text, masks``.

    A message lies in the shard in which it starts, so a shard holds ``size`` code points and at most one
    message more; a dialogue of ordinary length is one shard. ``masks`` are the trained spans, from the
    shard's own start.
    """
    if size < 1:
        raise ValueError("A shard needs room for a character")
    piece = F.struct("start", "rendered", "trained", "text_start", "text_end")
    grouped = messages.groupBy("conv_id", "perspective", F.floor(F.col("start") / size).alias("shard")).agg(
        F.array_sort(F.collect_list(piece)).alias("_m")
    )
    first = F.col("_m")[0]["start"]
    return grouped.select(
        "conv_id", "perspective", "shard", first.alias("start"),
        F.array_join(F.transform("_m", lambda m: m["rendered"]), "").alias("text"),
        F.transform(
            F.filter("_m", lambda m: m["trained"]),
            lambda m: F.struct((m["text_start"] - first).alias("start"), (m["text_end"] - first).alias("end")),
        ).alias("masks"),
    )
