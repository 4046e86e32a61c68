"""Chat formatting with cumulative snapshots collapsed, in DataFrame operations only.

Logs often hold a conversation again and again as it grows. The turns of each
conversation get rolling prefix hashes: a running sum of two 64-bit hashes of (place,
role, text). A conversation whose hash at its full length is a prefix hash of a longer
one is a snapshot of it; an anti-join keeps the others. Of conversations with equal
turns the one of the smallest id stays. Only then are conversations rendered.

Turns are ordered by (turn, role, text), so repeated turn numbers have a defined order.
A null role renders as `unknown`, a null text as empty, and they hash as such. Rows
without conv_id belong to no conversation and are left out. Equal rows are turns each.
Prefixes are matched by distinct keys on both sides, so a common first turn or
conversation is one row of the join. Rendering puts a conversation in one row, and so in
one task; its turns may be of any length. An empty table gives an empty result; other
columns are neither read nor returned.

What a role or text says can't pass for markup: a backslash goes before each backslash,
before the bar of `<|` in a text, and before a bar or line end in a role. parse() is the inverse.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: How a turn is rendered; turns follow one another without more.
TURN, END = "<|{}|>\n", "\n<|end|>\n"


def escaped_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\|\n]", r"\\$0")


_TURN = re.compile(r"<\|((?:[^\\|\n]|\\.)*)\|>\n(.*?)\n<\|end\|>\n", re.S)


def parse(rendered_: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation."""
    out, at = [], 0
    while at < len(rendered_):
        m = _TURN.match(rendered_, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append(tuple(re.sub(r"\\(.)", r"\1", x, flags=re.S) for x in m.groups()))
        at = m.end()
    return out


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n, h0, h1): the prefix hashes after each turn, n being the number of turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    placed = turns.withColumn("place", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(whole))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    h = [F.sum(F.xxhash64(F.lit(seed), "place", "role", "text").cast("decimal(20,0)")).over(upto).alias(f"h{i}") for i, seed in enumerate(("a", "b"))]
    return placed.select("conv_id", "place", "n", *h)


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that no other one continues, the smallest id of equal ones."""
    scratch = Scratch(conversations.sparkSession, "chat")
    hashes = scratch.table(prefix_hashes(_turns(conversations)), "hashes")
    full = hashes.where("place = n").groupBy("n", "h0", "h1").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    begun = hashes.where("place < n").select(F.col("place").alias("n"), "h0", "h1").distinct()
    kept = full.join(begun, ["n", "h0", "h1"], "left_anti")
    kept = scratch.table(kept.select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies"), "kept")
    scratch.keep(kept)
    return kept


def rendered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    kept = maximal(conversations)
    head, tail = TURN.split("{}")
    one = F.concat(F.lit(head), escaped_role(F.col("role")), F.lit(tail), escaped_text(F.col("text")), F.lit(END))
    turns = _turns(conversations).join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", one.alias("one")))).alias("turns"))
    texts = turns.select("conv_id", F.array_join(F.col("turns.one"), "").alias("rendered"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), marked AS (
  SELECT *, '<|' || regexp_replace(role, '[\\|\n]', '\\\0', 'g') || '|>' || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || chr(10) || '<|end|>' || chr(10) AS one FROM turns
), convs AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY place) AS said, string_agg(one, '' ORDER BY place) AS rendered
  FROM marked GROUP BY conv_id
), alone AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, said, min(rendered) AS rendered FROM convs GROUP BY n_turns, said
), starts AS (
  SELECT p.place AS n_turns, c.said[1:p.place] AS said FROM turns p JOIN convs c ON c.conv_id = p.conv_id AND p.place < c.n_turns
)
SELECT conv_id, n_turns, n_copies, rendered FROM alone a
WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.n_turns = a.n_turns AND s.said = a.said)
"""
