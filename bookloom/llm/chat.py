"""Chat formatting: logged snapshots of growing conversations are collapsed to the longest, then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.ordered import XOR, Ordered
from bookloom.session import cut_lineage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(c: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def chat_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """Rendered turns of the maximal conversations: conv_id, pos (1..n_turns), role, rendered, begin (characters of the
    conversation before the turn) and n_turns. A conversation's rendering is its turns' in order of pos.

    Each turn gets the hash of all turns up to it (two independent 64-bit values): the running XOR of hashes of pos and
    a hash of (role, text).
    A conversation whose last such value also stands inside a longer one is a snapshot of that one and goes; of conversations
    with the same turns the one with the smallest conv_id stays. Conversations and common prefixes of any length or number are
    spread over the tasks.

    Turns are ordered by turn, ties by role and text; repeated rows are turns of their own. A null role is `user`, roles are
    trimmed and lower-cased; a null text is empty; rows with a null conv_id are one conversation; a null turn comes
    first. An empty table gives an empty result. Extra columns are not returned.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.nullif(F.lower(F.trim(F.col(role))), F.lit("")), F.lit("user")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    rendered = F.concat(F.lit(OPEN), _clean(F.col("role")), F.lit("\n"), _clean(F.col("text")), F.lit(CLOSE + "\n"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    # texts are written once, in order; what follows reads their hashes and lengths only
    whole = Ordered(rows.withColumns({f"_x{i}": F.xxhash64(F.lit(i), F.lit("role"), "role", F.lit("text"), "text") for i in (1, 2)}
                                     | {"_size": F.length(rendered)}), ["conv_id"], order)
    line = whole.only("conv_id", "_x1", "_x2", "_size").add_all(pos=F.lit(1), _end=F.col("_size"))
    line = line.add_all(XOR, **{f"h{i}": F.xxhash64(F.lit(i), "pos", f"_x{i}") for i in (1, 2)})
    seen = cut_lineage(line.rows.select("_row", "conv_id", "pos", "h1", "h2", (F.col("_end") - F.col("_size")).alias("begin")))
    ends = seen.groupBy(F.col("conv_id").alias("_c")).agg(F.max("pos").alias("n_turns"))
    sized = seen.select("conv_id", "pos", "h1", "h2").join(ends, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    full = sized.where("pos = n_turns")
    one = full.groupBy("n_turns", "h1", "h2").agg(
        F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("conv_id"))
    # a proper prefix of some conversation; equal ones meet before the shuffle
    inner = sized.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    kept = one.join(inner, ["n_turns", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("_kept"), "n_turns")
    places = seen.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept"))).select("_row", "pos", "begin", "n_turns")
    return (whole.rows.select("_row", "conv_id", "role", "text").join(places, "_row")
            .select("conv_id", "pos", "role", rendered.alias("rendered"), "begin", "n_turns"))


def op4_chat_format(spark, folder: str) -> DataFrame:
    return chat_turns(spark.read.parquet(f"{folder}/conversations.parquet"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(nullif(lower(trim(role)), ''), 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations),
h AS (
  SELECT *, sha256(string_agg(sha256(role) || sha256(text), '' ORDER BY pos)
                   OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS prefix FROM t),
one AS (SELECT min(conv_id) AS conv_id, n_turns, prefix FROM h WHERE pos = n_turns GROUP BY n_turns, prefix),
kept AS (
  SELECT conv_id FROM one WHERE NOT EXISTS (
    SELECT 1 FROM h WHERE h.prefix = one.prefix AND h.pos = one.n_turns AND h.n_turns > one.n_turns)),
r AS (
  SELECT conv_id, pos, role, n_turns, '<|im_start|>' || replace(role, '<|', '< |') || chr(10)
         || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS rendered
  FROM t WHERE conv_id IN (SELECT conv_id FROM kept))
SELECT conv_id, pos, role, rendered, n_turns,
       (sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY pos) - length(rendered))::BIGINT AS "begin"
FROM r
"""
