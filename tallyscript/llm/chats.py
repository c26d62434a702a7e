"""Chat formatting: paths of reply trees by self-joins, ranked by score, each chosen one formatted as one conversation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscript.llm.common import discard, large_join, table, written

#: Fixed values of the template: what opens a turn, what ends its head and the turn, heads of the usual roles; other roles follow OTHER.
OPENS, HEAD_ENDS, TURN_ENDS, OTHER = "### ", ": ", "</turn>\n", "="
HEADS = {"system": "System", "user": "User", "assistant": "Assistant"}
#: A backslash goes before each of these: a backslash, a third # in a row, the slash of an end mark, a blank behind a colon (in roles only).
IN_TEXT, IN_ROLE = r"\\|(?<=##)#|(?<=<)/(?=turn>)", r"\\|(?<=##)#|(?<=<)/(?=turn>)|(?<=:) "

NODE = ["tree", "node"]


def as_key(*columns: str) -> Column:
    """The columns as one text that no other values give; nulls count as a value."""
    return F.concat_ws(",", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])


def messages_of(messages: DataFrame, conv: str = "conv_id", message: str = "message_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = "score") -> DataFrame:
    """Rows to conv_id, tree, node, up, role, text, score: the conversation's own id and its key, the message's and its parent's key.

    A null text or role is empty, a null score 0. Rows that repeat a message's id are messages of their own; the first by role,
    text and score has the replies.
    """
    rows = messages.select(F.col(conv).alias("conv_id"), as_key(conv).alias("tree"), as_key(message).alias("m"), F.when(F.col(parent).isNotNull(), as_key(parent)).alias("p"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"))
    repeat = F.row_number().over(Window.partitionBy("tree", "m").orderBy("role", "text", "score"))
    return rows.select("conv_id", "tree", F.concat("m", F.lit("#"), repeat.cast("string")).alias("node"), F.concat("p", F.lit("#1")).alias("up"), "role", "text", "score")


def messages_by_turn(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text to the form of messages_of(): each turn replies to the one before. Turns of one number are ordered by role and text."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", as_key("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.row_number().over(order))
    return rows.select("conv_id", "tree", F.col("place").cast("string").alias("node"), F.when(F.col("place") > 1, (F.col("place") - 1).cast("string")).alias("up"), "role", "text", F.lit(0.0).alias("score"))


def climbs(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes (tree, node, up, score) to the jumps (tree, node, up) of 1, 2, 4 ... messages, and of every node its path's steps and score.

    Each round joins the jumps with themselves, so a path of n messages takes log2(n) rounds. Nodes that reach their root
    leave; those that hang from a circle of replies never do, and are left when a round places none.
    """
    going = written(nodes.select(*NODE, "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "climb")
    done = going.where("up is null").drop("up")
    jumps, n_done = [], -1
    while True:
        jump = going.where("up is not null")
        if jump.isEmpty() or n_done == (n_done := done.count()):
            return jumps, done
        jumps.append(jump.select(*NODE, "up"))
        above = going.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("further"))
        root = done.select("tree", F.col("node").alias("up"), F.lit(None).cast("string").alias("next"), F.col("total").alias("more"), F.col("steps").alias("further"))
        above = above.where("next is not null").unionByName(root)
        going = written(large_join(jump, above, ["tree", "up"]).select(*NODE, F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps")), "climb")
        done = done.unionByName(going.where("up is null").drop("up"))


def chosen_paths(nodes: DataFrame, most: int = 1) -> DataFrame:
    """nodes (tree, node, up, score) to the messages of each tree's best paths from its roots to leaves: tree, rank, node, back (0 at the leaf).

    Paths rank by their messages' mean score, then the longer one, then the leaf's key. A parent that isn't there makes a root.
    Scores are summed along paths before any path is written out, so only the chosen ones are.
    """
    known = nodes.select("tree", F.col("node").alias("up"), F.lit(True).alias("known"))
    nodes = written(large_join(nodes, known, ["tree", "up"], "left").select(*NODE, F.when(F.col("known"), F.col("up")).alias("up"), "score"), "nodes")
    jumps, done = climbs(nodes)
    leaves = large_join(done, nodes.where("up is not null").select("tree", F.col("up").alias("node")), NODE, "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node"))
    best = leaves.withColumn("rank", rank).where(F.col("rank") <= most)
    path = written(best.select("tree", "rank", "node", F.lit(0).cast("long").alias("back")), "path")
    for k, jump in enumerate(jumps):
        further = large_join(path, jump, NODE).select("tree", "rank", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        if further.isEmpty():
            break
        path = written(path.unionByName(further), "path")
    return path


def escaped(text: Column, pattern: str = IN_TEXT) -> Column:
    return F.regexp_replace(text, pattern, r"\\$0")


def head_of(role: Column) -> Column:
    named = F.lit(None).cast("string")
    for name, head in HEADS.items():
        named = F.when(role == name, head).otherwise(named)
    return F.concat(F.lit(OPENS), F.coalesce(named, F.concat(F.lit(OTHER), escaped(role, IN_ROLE))), F.lit(HEAD_ENDS))


def format_paths(messages: DataFrame, most: int = 1) -> DataFrame:
    """messages of messages_of() to a row per chosen path: conv_id, rank, n_turns, document, loss.

    document holds the turns, each `### Role: text</turn>` and a line's end; a backslash goes before what would read as a mark
    (IN_TEXT), so that reading drops it again. loss lists start and end, in code points, of the assistant's texts in it.
    Ids, parents and scores alone are joined to find the paths; texts are shuffled to their paths once.

    Messages that hang from a circle of replies have no root and no path. Null ids of conversations are one conversation. An
    empty table gives no row. A path must fit a row, as it is one document.
    """
    path = chosen_paths(messages.select(*NODE, "up", "score"), most)
    turns = large_join(messages.drop("up", "score"), path, NODE)
    head, body = head_of(F.col("role")), escaped(F.col("text"))
    turns = turns.select("conv_id", "tree", "rank", "back", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("own"))
    before = F.sum(F.length("head") + F.length("body") + len(TURN_ENDS)).over(Window.partitionBy("tree", "rank").orderBy(F.desc("back")))
    ends = before - len(TURN_ENDS)
    placed = turns.select("conv_id", "tree", "rank", "back", F.concat("head", "body", F.lit(TURN_ENDS)).alias("turn"), F.when(F.col("own"), F.struct((ends - F.length("body")).cast("long").alias("start"), ends.cast("long").alias("end"))).alias("span"))
    rows = placed.groupBy("tree", "rank").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "turn", "span"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return rows.select("conv_id", "rank", "n_turns", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("document"), spans.alias("loss"))


UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def turns_of(document: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a document."""
    roles = {head: role for role, head in HEADS.items()}
    found = []
    for turn in document.split(TURN_ENDS)[:-1]:
        head, _, body = turn[len(OPENS) :].partition(HEAD_ENDS)
        found.append((unescaped(head[len(OTHER) :]) if head.startswith(OTHER) else roles[head], unescaped(body)))
    return found


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Of each row of format_paths(), from document and loss alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, document, loss in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                turns, kept = hashlib.sha256(), [unescaped(document[s["start"] : s["end"]]) for s in loss]
                found = turns_of(document)
                for role, text in found:
                    turns.update(f"{role}\n{text}\n".encode())
                rows.append([conv, len(found), turns.hexdigest(), sum(map(len, kept)), hashlib.sha256("".join(kept).encode()).hexdigest(), len(document)])
            yield pa.RecordBatch.from_pylist([dict(zip(READ.names, r, strict=True)) for r in rows], READ)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "document", "loss").mapInArrow(read, kinds)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold the template's own marks, formatted, written, and read back."""
    marks = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), marks.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    messages = written(messages_by_turn(turns), "messages")
    formatted = written(format_paths(messages), "formatted")
    discard(messages)
    return read_back(formatted)


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), m AS (
  SELECT *, length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' ELSE '### Assistant: ' END) + length(text) + length('</turn>') + 1
    + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
