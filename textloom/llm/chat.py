"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once, with that speaker as the assistant, the others as
named users and system turns as they are. A rendering is a row for each turn with its place in the whole text, so that a
conversation of any length is spread over many tasks; render_dialogues() joins the pieces where whole strings are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The system's role takes no part as a speaker; turns without a role are by this speaker.
SYSTEM, UNKNOWN = "system", "unknown"
#: Turns of a conversation that one task numbers at a time.
BLOCK = 256


def turn_header(role: Column, name: Column) -> Column:
    """The header of a turn. Markers in a name are broken up, and line breaks are spaces there, so that it can't end the header."""
    safe = F.translate(F.replace(name, F.lit("<|"), F.lit("<\\|")), "\r\n", "  ")
    return F.concat(F.lit("<|im_start|>"), role, F.when(role == "user", F.concat(F.lit(" name="), safe)).otherwise(F.lit("")), F.lit("\n"))


def rotate_perspectives(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, seq, turn, role, name, segment, start, end, mask_start, mask_end) for each turn and participant.

    `conversations`: (conv_id, turn, role, text). `segment` is the rendered turn, [start, end) its place, in characters,
    in the rendering of its conversation for `speaker`; the loss mask is [mask_start, mask_end), the content and end mark
    of that speaker's turns, null elsewhere. Markers within a text or name are broken up by a backslash, and line breaks in a
    name are spaces in its header, so that neither can open or close a turn. Turns are in the order of (turn, role, text), nulls first; repeated rows are repeated turns. A
    null text is empty, a null role is a participant named "unknown", a null conv_id is a conversation of its own, and
    a conversation of system turns alone has no participant and no row. An empty table gives an empty result. Columns of
    `conversations` with other names are not read.

    Renderings are as many as participants, so rows are turns times participants of their conversation, which is what
    is asked for. Places are sums in two steps, in blocks of about `BLOCK` turn numbers and over the blocks' totals.
    """
    c = conversations.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    c = c.withColumn("text", F.replace("text", F.lit("<|"), F.lit("<\\|")))
    c = c.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    speakers = c.where(F.col("name") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("name").alias("speaker")).distinct()
    t = c.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    role = F.when(F.col("name") == SYSTEM, SYSTEM).when(F.col("name") == F.col("speaker"), "assistant").otherwise("user")
    t = t.withColumn("role", role).withColumn("head", turn_header(F.col("role"), F.col("name")))
    t = t.withColumn("segment", F.concat("head", "text", F.lit("<|im_end|>\n"))).withColumn("size", F.length("segment").cast("long"))

    blocks = t.groupBy("conv_id", "speaker", "block").agg(F.sum("size").alias("all"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"),
        F.coalesce(F.sum("all").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"),
    )
    local = Window.partitionBy("conv_id", "speaker", "block").orderBy(F.col("turn").asc_nulls_first(), "name", "text")
    running = local.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("inner", F.coalesce(F.sum("size").over(running), F.lit(0))).withColumn("nth", F.row_number().over(local))
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("block") == F.col("b")))
    start = F.col("at") + F.col("inner")
    mine = F.col("role") == "assistant"
    return t.select(
        "conv_id", "speaker", (F.col("seen") + F.col("nth") - 1).cast("long").alias("seq"), "turn", "role", "name", "segment",
        start.cast("long").alias("start"), (start + F.col("size")).cast("long").alias("end"),
        F.when(mine, start + F.length("head")).cast("long").alias("mask_start"), F.when(mine, start + F.col("size") - 1).cast("long").alias("mask_end"),
    )


def render_dialogues(rotated: DataFrame) -> DataFrame:
    """(conv_id, speaker, text, mask): whole renderings with the list of their loss spans. For conversations of a size
    that fits a row; an unbounded one is better left in the pieces that rotate_perspectives() gives."""
    piece = F.struct("seq", "segment", "mask_start", "mask_end")
    whole = rotated.groupBy("conv_id", "speaker").agg(F.sort_array(F.collect_list(piece)).alias("x"))
    spans = F.transform(F.filter("x", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    return whole.select("conv_id", "speaker", F.array_join(F.transform("x", lambda p: p["segment"]), "").alias("text"), spans.alias("mask"))


SQL = """
WITH c AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS name, replace(coalesce(text, ''), '<|', '<' || chr(92) || '|') AS text
  FROM conversations
), s AS (SELECT DISTINCT conv_id, name AS speaker FROM c WHERE name <> 'system'),
t AS (
  SELECT c.conv_id, s.speaker, c.turn, c.name, c.text,
    CASE WHEN c.name = 'system' THEN 'system' WHEN c.name = s.speaker THEN 'assistant' ELSE 'user' END AS role
  FROM c JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
), h AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || translate(replace(name, '<|', '<' || chr(92) || '|'), chr(13) || chr(10), '  ') ELSE '' END || chr(10) AS head FROM t
), g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, length(segment) AS size,
    row_number() OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, text) - 1 AS seq,
    coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM g
)
SELECT conv_id, speaker, CAST(seq AS BIGINT) AS seq, turn, role, name, segment, CAST(pos AS BIGINT) AS start, CAST(pos + size AS BIGINT) AS "end",
  CAST(CASE WHEN role = 'assistant' THEN pos + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN role = 'assistant' THEN pos + size - 1 END AS BIGINT) AS mask_end
FROM o
"""
