"""Operator 8, chat formatting: conversations merged into prefix trees whose shared turns are written once.

Conversations become rows of their ordered turns and are range-partitioned by the hashes of their turns, so that those
which share initial turns lie side by side and a common first turn is spread over many tasks. Each task walks its sorted
conversations, and writes a turn only where it leaves the path of the one before: that is the depth-first order of a
prefix tree. Trees are closed at a bounded size; a tree that follows repeats the shared path once. A row of the result
is a tree: its text, and for each node its place, parent, first position id (the length of its ancestors, so positions of
a branch go on where its parent ends), the intervals of the text that it attends to (its ancestors', joined where they
touch) and the interval under the loss mask; and for each conversation its last node.

Template of a turn: ``### {role}: {text}</turn>`` and a line end. In texts and roles a backslash goes before a
backslash and before what would begin ``###`` or ``</turn>``, and in roles before a colon; reading back takes
backslashes away again, so every text survives.

Edge cases: null texts and roles are empty; turns are ordered by (turn, role, text), nulls first; repeated rows are turns
of their own; a null conv_id is a conversation too; equal conversations share all nodes; an empty table gives no rows. A
conversation has to fit into the memory of a task, as a text has.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.llm.common import read

#: A tree is closed at so many characters or conversations.
TREE_CHARS, TREE_CONVERSATIONS = 400_000, 2_000
CONTROL, ROLE_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)"), re.compile(r"\\|:|#(?=##)|<(?=/turn>)")
#: A turn as it is read back: role and text are runs of escaped pairs and of other characters that begin no control.
TURN = re.compile(r"### ((?:\\.|[^\\:])*?): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)
TREE = (
    "text string, nodes array<struct<start:long,length:long,parent:int,position:long,attends:array<struct<start:long,end:long>>,"
    "loss_start:long,loss_end:long>>, conversations array<struct<conv_id:long,node:int>>"
)


def escape(s: str, control=CONTROL) -> str:
    return control.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn by the template, and the interval of its text within it."""
    head, body = f"### {escape(role, ROLE_CONTROL)}: ", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turn(formatted: str) -> tuple[str, str, int, int]:
    """Role, text and the text's interval of one formatted turn."""
    m = TURN.fullmatch(formatted)
    return unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)


class Tree:
    """A prefix tree in depth-first order of its writing."""

    def __init__(self):
        self.text, self.size, self.nodes, self.conversations = [], 0, [], []
        self.path: list[tuple[tuple[str, str], int]] = []  # of the last conversation: turn and node

    def add(self, conv_id, turns: list[tuple[str, str]], trained: str) -> None:
        same = 0
        while same < min(len(turns), len(self.path)) and self.path[same][0] == turns[same]:
            same += 1
        del self.path[same:]
        for turn in turns[same:]:
            parent = self.path[-1][1] if self.path else -1
            formatted, lo, hi = format_turn(*turn)
            up = self.nodes[parent] if parent >= 0 else None
            attends = [dict(x) for x in up["attends"]] if up else []
            if up:
                if attends and attends[-1]["end"] == up["start"]:
                    attends[-1]["end"] += up["length"]
                else:
                    attends.append({"start": up["start"], "end": up["start"] + up["length"]})
            loss = (self.size + lo, self.size + hi) if turn[0] == trained else (None, None)
            self.nodes.append({"start": self.size, "length": len(formatted), "parent": parent, "position": up["position"] + up["length"] if up else 0, "attends": attends, "loss_start": loss[0], "loss_end": loss[1]})
            self.path.append((turn, len(self.nodes) - 1))
            self.text.append(formatted)
            self.size += len(formatted)
        self.conversations.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})

    def row(self) -> dict:
        return {"text": "".join(self.text), "nodes": self.nodes, "conversations": self.conversations}


def conversation_trees(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Prefix trees of ``turns(conv_id, turn, role, text)``; the texts of role ``trained`` are under the loss mask."""
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).alias("t"))
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    key = F.array_join(F.transform("turns", lambda t: F.hex(F.xxhash64(t["role"], t["text"]))), "")
    dealt = whole.withColumn("key", key).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def run(batches):
        tree = Tree()
        for b in batches:
            for conv_id, turns in zip(b["conv_id"].astype("Int64"), b["turns"]):
                tree.add(None if pd.isna(conv_id) else int(conv_id), [(t["role"], t["text"]) for t in turns], trained)
                if tree.size >= TREE_CHARS or len(tree.conversations) >= TREE_CONVERSATIONS:
                    yield pd.DataFrame([tree.row()])
                    tree = Tree()
        if tree.conversations:
            yield pd.DataFrame([tree.row()])

    return dealt.select("conv_id", "turns").mapInPandas(run, TREE)


def read_back(trees: DataFrame) -> DataFrame:
    """One row for each conversation, from the trees alone: the contract's digests of its turns and of its loss mask."""

    def run(batches):
        for b in batches:
            rows = []
            for text, nodes, conversations in zip(b["text"], b["nodes"], b["conversations"]):
                parsed = {}
                for i, x in enumerate(nodes):
                    role, said, _, _ = read_turn(text[x["start"] : x["start"] + x["length"]])
                    masked = unescape(text[int(x["loss_start"]) : int(x["loss_end"])]) if x["loss_start"] is not None else None
                    parsed[i] = (f"{role}\n{said}\n".encode(), masked, x["length"], x["parent"])
                for c in conversations:
                    path, at = [], c["node"]
                    while at >= 0:
                        path.append(parsed[at])
                        at = parsed[at][3]
                    path.reverse()
                    loss = "".join(p[1] for p in path if p[1] is not None)
                    rows.append((c["conv_id"], len(path), hashlib.sha256(b"".join(p[0] for p in path)).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(p[2] for p in path)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return trees.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The planted conversation of the contract: its texts hold the template's own control strings.
PLANTED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -7, formatted into trees and read back from these."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return read_back(conversation_trees(turns.unionByName(planted)))


#: In SQL an escape costs one character for each backslash, each ``#`` that two more follow, and each ``</turn>``; no role has any.
OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
measured AS (
  SELECT *, 14 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
            + (length(text) - length(replace(text, '</turn>', ''))) // 7
            + coalesce(list_sum(list_transform(regexp_extract_all(text, '##(#+)', 1), lambda x: length(x))), 0) AS formatted
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id
"""
