"""Chat formatting with cumulative-snapshot collapse.

A log that snapshots a conversation after every turn holds each prefix as a conversation
of its own. Every turn gets two hashes of its place, role and text; their running sums
over a conversation (a window, one step a turn) roll on from prefix to prefix. A
conversation is dropped if a longer one begins with all of its turns (anti-join of whole
hashes with distinct proper prefixes), and of equal ones the smallest id stays. Both
sides of the anti-join hold a hash once, however many conversations share a first turn
or a whole text, so no key is hot. The rest is rendered.

A conversation is one row when it is rendered, so its own turns have to fit one task;
all else grows in proportion to its turns. Turns without an id are no conversation of
one another: each is its own, so that they are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

NOTHING = "\u0000"
#: What a marker begins with, and how it is written inside a turn.
MARK, WRITTEN = "<|", "< |"


def _prefixes(packed: DataFrame) -> DataFrame:
    """conv_id, alone, n_turns, n and s1 to s4 of every prefix: sums of the halves of its turns' hashes, which fit 2**31 turns."""
    turns = packed.select("conv_id", "alone", "n_turns", F.posexplode("turns").alias("at", "t"))
    hashed = turns.select("conv_id", "alone", "n_turns", "at", *[F.xxhash64(F.lit(k), "at", F.coalesce("t.role", F.lit(NOTHING)), F.coalesce("t.text", F.lit(NOTHING))).alias(f"h{k}") for k in (1, 2)])
    so_far = Window.partitionBy("conv_id", "alone").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    halves = [half for h in ("h1", "h2") for half in (F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(F.lit((1 << 32) - 1)))]
    return hashed.select("conv_id", "alone", "n_turns", (F.col("at") + 1).alias("n"), *[F.sum(half).over(so_far).alias(f"s{i + 1}") for i, half in enumerate(halves)])


def collapse_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns (array of turn, role, text in order) and n_turns of every maximal conversation.

    Turns are ordered by turn number (nulls first), then role and text; rows that repeat
    exactly are one turn. Turns compare by role and text, not by number; null equals
    null only. A row without an id is a conversation of one turn, whose id is null. Of
    equal conversations the smallest id stays (null only if none has one). Texts of any
    length are hashed whole. An empty table gives an empty table; other columns are
    ignored, whatever their names.
    """
    t = F.struct(F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), t.alias("t")).withColumn("alone", F.when(F.col("conv_id").isNull(), F.col("t")))
    packed = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    packed = stored(packed.withColumn("n_turns", F.size("turns").cast("long")), "conversations")
    prefixes = stored(_prefixes(packed), "turn-prefixes")
    sums = ["n", "s1", "s2", "s3", "s4"]
    least = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "alone")).alias("who")
    whole = prefixes.where("n = n_turns").groupBy(*sums).agg(least)
    inner = prefixes.where("n < n_turns").select(*sums).distinct()
    maximal = whole.join(inner, sums, "left_anti").select(F.col("who.conv_id").alias("_c"), F.col("who.alone").alias("_a"))
    return packed.join(maximal, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("alone").eqNullSafe(F.col("_a")), "left_semi").select("conv_id", "turns", "n_turns")


def render(turns: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """role and text of each turn between markers; a null role is 'unknown', a null text empty.

    What begins a marker inside a role or text gets a space after its first character, so that no turn can forge another.
    """
    plain = lambda c, null: F.replace(F.coalesce(c, F.lit(null)), F.lit(MARK), F.lit(WRITTEN))
    one = lambda t: F.concat(F.lit(start), plain(t["role"], "unknown"), F.lit("\n"), plain(t["text"], ""), F.lit(end))
    return F.array_join(F.transform(turns, one), "\n")


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    kept = collapse_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return kept.select("conv_id", "n_turns", render(F.col("turns")).alias("chat"))


OP10_SQL = r"""
WITH t AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER (ORDER BY turn, role, text) END AS alone FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), c AS (
  SELECT conv_id, alone, count(*) AS n_turns, list(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) ORDER BY turn, role, text) AS k,
         string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>', chr(10) ORDER BY turn, role, text) AS chat
  FROM t GROUP BY conv_id, alone
), p AS (
  SELECT DISTINCT md5(CAST(k[1:i] AS VARCHAR)) AS h, i FROM (SELECT k, unnest(range(1, n_turns)) AS i FROM c)
), u AS (
  SELECT *, md5(CAST(k AS VARCHAR)) AS h, row_number() OVER (PARTITION BY k ORDER BY conv_id NULLS LAST, alone) AS rn FROM c
)
SELECT conv_id, n_turns, chat FROM u WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM p WHERE p.h = u.h AND p.i = u.n_turns)
"""
