"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as
the prompt; what follows is rendered for each as a completion. The mask of a completion lists the
character spans that are trained on: the texts of the assistant's turns with their end mark.
DataFrame functions only; turns are gathered by conversation, conversations meet in equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def _turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order."""
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """The spans (start, end) of trained text in the rendered turns."""
    none = F.array().cast("array<struct<start: int, end: int>>")

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + len(OPEN) + len(MIDDLE) + F.char_length(t["role"])
        end = start + F.char_length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == TRAINED, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each row of ``pairs`` (pair_id, chosen, rejected: conversation ids).

    ``turns`` has conv_id, turn, role and text. The result has pair_id, prefix_turns, prompt, chosen,
    rejected and the masks of both completions. Turns are ordered by turn, then role, then text;
    repeated turns are kept; null roles and texts count as empty; turns without a conversation are
    ignored. A conversation that is missing or null has no turns. Equal conversations give two empty
    completions. Other columns play no part.
    """
    convs = _turns(turns.select("conv_id", "turn", "role", "text"))
    none = F.array().cast(dict(convs.dtypes)["turns"])
    rows = pairs.select("pair_id", F.col("chosen").alias("c_id"), F.col("rejected").alias("r_id"))
    rows = rows.join(convs.select(F.col("conv_id").alias("c_id"), F.col("turns").alias("c")), "c_id", "left")
    rows = rows.join(convs.select(F.col("conv_id").alias("r_id"), F.col("turns").alias("r")), "r_id", "left")
    rows = rows.withColumns({"c": F.coalesce("c", none), "r": F.coalesce("r", none)})
    same = F.zip_with(
        "c", "r", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull()
    )
    differs = F.array_position(same, False)
    rows = rows.withColumn("prefix_turns", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int"))
    after = lambda side: F.slice(side, F.col("prefix_turns") + 1, F.greatest(F.size(side), F.lit(1)))
    rows = rows.withColumns({"prefix": F.slice("c", F.lit(1), F.col("prefix_turns")), "c": after("c"), "r": after("r")})
    return rows.select(
        "pair_id",
        "prefix_turns",
        _rendered(F.col("prefix")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def with_other_endings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs that set each conversation against itself with another one's last turn.

    Conversations 2i and 2i + 1 lend each other their last turn; without a partner the rejected one just
    lacks its last turn. The chosen conversation of c is named 2c, the rejected one 2c + 1; ids may be
    negative, but not beyond 62 bits. Turns without a conversation are ignored.
    """
    named = lambda rejected: F.shiftleft(F.col("conv_id").cast("long"), 1).bitwiseOR(F.lit(rejected).cast("long"))
    turns = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by(F.struct("role", "text"), F.struct("turn", "role", "text")).alias("end"))
    begun = turns.join(last.select("conv_id", "last"), "conv_id").where("turn < last or turn is null").select(named(1).alias("conv_id"), "turn", "role", "text")
    lent = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), "end").join(last.select("conv_id", "last"), "conv_id")
    lent = lent.select(named(1).alias("conv_id"), F.col("last").alias("turn"), "end.role", "end.text")
    pairs = last.select(F.col("conv_id").alias("pair_id"), named(0).alias("chosen"), named(1).alias("rejected"))
    return turns.withColumn("conv_id", named(0)).union(begun).union(lent), pairs


#: DuckDB SQL of the query ``op8_preference``.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ends AS (
  SELECT conv_id, max(turn) AS last, arg_max(struct_pack(role := role, text := text), struct_pack(a := turn, b := role, c := text)) AS fin
  FROM t GROUP BY conv_id
), others AS (
  SELECT t.conv_id, turn, role, text FROM t JOIN ends USING (conv_id) WHERE turn < last OR turn IS NULL
  UNION ALL
  SELECT mine.conv_id, mine.last, theirs.fin.role, theirs.fin.text
  FROM ends AS mine JOIN ends AS theirs ON theirs.conv_id = xor(mine.conv_id, 1)
), c AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM others
), prefixes AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS pair_id,
         coalesce(min(coalesce(c.pos, r.pos)) FILTER (WHERE c.pos IS NULL OR r.pos IS NULL OR c.role <> r.role OR c.text <> r.text) - 1, max(c.pos)) AS p
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.pos = r.pos GROUP BY 1
), sides AS (
  SELECT 'c' AS side, c.*, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM c
  UNION ALL
  SELECT 'r', r.*, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) FROM r
), placed AS (
  SELECT s.*, p.p, sum(CASE WHEN pos > p.p THEN length(shown) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY pos) AS stop
  FROM sides s JOIN prefixes p ON p.pair_id = s.conv_id
)
SELECT conv_id AS pair_id, CAST(max(p) AS INTEGER) AS prefix_turns,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 'c' AND pos <= p), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 'c' AND pos > p), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 'r' AND pos > p), '') AS rejected,
       coalesce(string_agg((stop - length(text) - 11)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY pos) FILTER (WHERE side = 'c' AND pos > p AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((stop - length(text) - 11)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY pos) FILTER (WHERE side = 'r' AND pos > p AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
