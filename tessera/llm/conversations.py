"""Chat formatting: logged snapshots of conversations collapsed to the maximal ones, then rendered. Built-in functions only.

A log often holds a conversation again after every turn. The turns of each snapshot are hashed in order into rolling prefix
hashes; the distinct (length, hash) of proper prefixes, aggregated before the shuffle so that a common first turn is one
row, are the right side of an anti-join that drops every snapshot equal to one. Of equal snapshots the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table

START, END = "<|im_start|>", "<|im_end|>"


def _turns(conv: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    return conv.select(
        F.col(key).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def prefix_hashes(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, prefixes): the rolling hash after each turn, 128 bits as hexadecimal."""
    t = _turns(conv, key, turn, role, text)
    own = F.md5(F.concat_ws("\x1f", F.length("role").cast("string"), "role", "text"))
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("t"), own.alias("h")))).alias("turns"))

    def roll(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), x["h"]))))

    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", F.array().cast("array<string>"), roll).alias("prefixes"))


def maximal(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies) of snapshots that no longer one extends, one for each group of equal snapshots."""
    p = prefix_hashes(conv, key, turn, role, text)
    ends = p.groupBy("n_turns", F.element_at("prefixes", -1).alias("h")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = p.select(F.posexplode(F.slice("prefixes", 1, F.greatest(F.size("prefixes") - 1, F.lit(0)))).alias("at", "h")).select((F.col("at") + 1).cast("long").alias("n_turns"), "h").distinct()
    return ends.join(proper, ["n_turns", "h"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(conv: DataFrame, keep: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of ``keep`` with the conversation's turns in chat markup."""
    t = _turns(conv, key, turn, role, text)
    line = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    kept = t.join(keep.select(F.col("conv_id").alias("k")), t["conv_id"].eqNullSafe(F.col("k")), "left_semi")
    chat = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("t"), line.alias("line")))).alias("turns"))
    shown = chat.select(F.col("conv_id").alias("k"), F.array_join(F.transform("turns", lambda x: x["line"]), "").alias("chat"))
    return keep.join(shown, keep["conv_id"].eqNullSafe(shown["k"])).drop("k")


def format_chats(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) of the maximal conversations.

    Null role and text are empty ones; rows with a null conv_id are one conversation. Turns of one number (repeated rows too)
    are all kept, in order of role and the text's digest; a null turn comes first. Other columns are not carried; an
    empty table gives an empty result.
    """
    return render(conv, maximal(conv, key, turn, role, text), key, turn, role, text)


def op2_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(role || chr(31) || text ORDER BY turn, role, md5(text)) AS turns, count(*) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, md5(text)) AS chat FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT k AS n_turns, list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
e AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n_turns)
SELECT e.conv_id, e.n_turns::BIGINT AS n_turns, e.n_copies::BIGINT AS n_copies, c.chat FROM e JOIN c ON c.conv_id = e.conv_id
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n_turns = e.n_turns AND p.turns = e.turns)
"""
