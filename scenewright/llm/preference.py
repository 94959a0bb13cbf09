"""Preference formatting with DataFrame operations only: prompt, chosen and rejected completion of paired conversations.

The turns of both conversations of a pair, in order, are compared one by one; the longest run of equal turns at their
beginning is rendered once as the prompt, and what follows in either conversation is its completion.  A completion's mask
lists the spans of characters to train on: the text and the closing mark of the assistant's turns; the marks that open a
turn and the turns of others are never trained on.  Rejoining prompt and completion gives the conversation as a whole.

Pairs are grouped once; a row holds the two conversations of a pair, which the result has as one row anyway, and nothing
larger is gathered: pairs of a popular first turn, or copies of one conversation, are separate groups.

Defined results: turns without conversation id have no pair and go; turns are ordered by turn, then role, then text, null
first, so gaps and repeated turns are kept in that order; null roles and texts count as empty; a pair of which one side is
missing has an empty prompt and an empty completion there; equal conversations have empty completions; conversations
without any common turn have an empty prompt; turns of any length are rendered whole (a pair must fit in a row); repeated
conversations give equal rows; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before the role, between role and text, and after the text (fixed values of the chat format).
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BETWEEN))


def _tail(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def _mask(turns: Column, trained: str) -> Column:
    """Spans [start, end) of characters of the rendered turns."""
    spans = "array<struct<start: int, end: int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(_head(t))
        last = first + F.length(_tail(t))
        own = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct(last.alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame, *, pair: Column, is_chosen: Column, trained: str = TRAINED) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    turns: conv_id, turn, role, text; `pair` and `is_chosen` are columns over them, the same for all turns of one
    conversation.  A pair whose id or side is null goes."""
    t = turns.select(
        pair.alias("pair_id"), is_chosen.alias("c"),
        F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    ).filter("pair_id IS NOT NULL AND c IS NOT NULL")
    sides = t.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("c") == side, F.col("t")))).alias(name) for name, side in (("a", True), ("b", False))])
    # array_sort puts nulls last; a turn number that is null comes first by its struct
    shared = F.least(F.size("a"), F.size("b"))
    equal = F.zip_with(F.slice("a", 1, shared), F.slice("b", 1, shared), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    n = F.coalesce(F.nullif(F.array_position(equal, F.lit(False)), F.lit(0)) - 1, shared).cast("int")
    cut = sides.withColumn("n", n)
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    return cut.select(
        "pair_id", F.col("n").alias("n_prompt_turns"), _render(F.slice("a", 1, F.col("n"))).alias("prompt"),
        _render(rest("a")).alias("chosen"), _render(rest("b")).alias("rejected"),
        _mask(rest("a"), trained).alias("chosen_mask"), _mask(rest("b"), trained).alias("rejected_mask"),
    )


def _flat(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(mask)


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations of the table: those with ids 2k are the chosen ones of pair k, those with 2k + 1 the rejected."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = format_pairs(turns, pair=F.floor(F.col("conv_id") / 2), is_chosen=F.pmod("conv_id", F.lit(2)) == 0)
    return out.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", _flat("chosen_mask"), _flat("rejected_mask"))


def _sql() -> str:
    render = f"string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE[:-1]}' || chr(10), '' ORDER BY pos)"
    side = lambda s, name: f"coalesce({render} FILTER (side = {s} AND pos > n), '') AS {name}"
    mask = lambda s, name: f"coalesce(string_agg((upto - tail) || '-' || upto, ',' ORDER BY pos) FILTER (side = {s} AND pos > n AND role = '{TRAINED}'), '') AS {name}"
    return f"""
WITH t AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, abs(conv_id) % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT pair_id FROM t),
bad AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.pos, b.pos)) AS pos FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos
        WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
n AS (SELECT p.pair_id, CAST(coalesce(bad.pos - 1, (SELECT max(pos) FROM t WHERE t.pair_id = p.pair_id)) AS INTEGER) AS n FROM p LEFT JOIN bad USING (pair_id)),
u AS (SELECT t.*, n, length(text) + {len(CLOSE)} AS tail, CASE WHEN pos > n THEN sum(length(role) + length(text) + {len(OPEN) + len(BETWEEN) + len(CLOSE)}) FILTER (pos > n) OVER (PARTITION BY t.pair_id, side ORDER BY pos) END AS upto FROM t JOIN n USING (pair_id))
SELECT pair_id, n AS n_prompt_turns, coalesce({render} FILTER (side = 0 AND pos <= n), '') AS prompt, {side(0, 'chosen')}, {side(1, 'rejected')}, {mask(0, 'chosen_mask')}, {mask(1, 'rejected_mask')}
FROM u GROUP BY pair_id, n
"""


ORACLE = _sql()
