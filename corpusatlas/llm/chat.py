"""Conversations from reply trees.

Messages point to their parents. Pointer doubling (each round joins the table with itself and doubles how far a pointer
reaches) gives each message its root, depth and the sum of scores on its path; leaves are ranked by mean score within a
root and the chosen leaves' paths are walked back with the same pointers, so rounds grow with the logarithm of the depth.
Each path becomes one conversation in this form:

    ### Role: text</turn>\\n

Inside texts and roles a backslash before each of the control strings `\\`, `### `, `</turn>` (and, in roles, `: `) makes
them ordinary, so the form reads back exactly. The loss mask covers the escaped texts of assistant turns.

The tables may hold: null texts (empty), null roles (empty), null ids (messages: dropped, they can't be referred to;
conversations: one of their own), parents that are missing (the message is a root) or form a cycle (its messages have no
root and are left out), repeated turns (in order of role and text), repeated message ids (one whole row counts, see
one_each), texts of any length (a conversation is one row), any depth, nothing, any other columns (not read).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.llm.common import materialise

HEAD, SPLIT, END = "### ", ": ", "</turn>\n"
CONTROL = re.compile(r"\\|### |</turn>")
CONTROL_ROLE = re.compile(r"\\|### |</turn>|: ")


def escape(text: str, control=CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


TURN = re.compile(r"### ((?:[^\\]|\\.)*?): ((?:[^\\]|\\.)*?)</turn>\n", re.S)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans (code points) under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role, CONTROL_ROLE)}{SPLIT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + END)
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything else is an error."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def from_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages: tree, id, parent, role, text, score. Each turn replies to the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(w).cast("long")
    # a conversation is one output row in the end, so its turns fit one task
    return conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), n.alias("n")).select(F.col("conv_id").cast("string").alias("tree"), F.struct(F.col("conv_id").cast("string").alias("c"), F.col("n").alias("n")).alias("id"), F.when(F.col("n") > 1, F.struct(F.col("conv_id").cast("string").alias("c"), (F.col("n") - 1).alias("n"))).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def one_each(messages: DataFrame) -> DataFrame:
    """One whole row per id that is not null: of repeated ids the first by parent, score, tree, role and text."""
    columns = ["parent", "score", "tree", "role", "text"]
    return messages.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(*columns)).alias("m")).select("id", "m.*")


def enumerate_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(path, place, id): the messages on the paths of each root's `branches` best leaves, from the root on."""
    return _paths(one_each(messages), branches)


def _paths(messages: DataFrame, branches: int) -> DataFrame:
    base = materialise(messages.select("id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    known = base.select(F.col("id").alias("parent"))
    up = materialise(base.join(known.withColumn("there", F.lit(True)), "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"), F.col("id").alias("top")), "pointers")
    # jumps[k]: where 2**k steps up lead. Messages that have come to their root wait; only the others go on
    jumps, arrived, under_way = [up], up.filter(F.col("up").isNull()), up.filter(F.col("up").isNotNull())
    for _ in range(up.count().bit_length()):  # what has not come to a root by then is a cycle
        if under_way.isEmpty():
            break
        ahead = arrived.unionByName(under_way).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("total").alias("t"), F.col("top").alias("root"))
        up = materialise(under_way.join(ahead, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total"), F.col("root").alias("top")), "pointers")
        jumps.append(up)
        arrived, under_way = arrived.unionByName(up.filter(F.col("up").isNull())), up.filter(F.col("up").isNotNull())
    rooted = arrived
    leaves = rooted.join(base.select(F.col("parent").alias("id")).filter(F.col("id").isNotNull()).distinct(), "id", "left_anti")
    # the best branches of a root, in two steps so that no root's leaves meet in one task before they are few
    order = [F.desc(F.col("total") / F.col("depth")), F.desc("depth"), F.asc("id")]
    some = leaves.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("top", "salt").orderBy(*order))).filter(F.col("r") <= branches)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("top").orderBy(*order))).filter(F.col("r") <= branches)
    walk = best.select(F.col("id").alias("path"), "id", F.lit(0).cast("long").alias("steps"), F.col("depth").alias("length"))
    for k in range(len(jumps) - 1, -1, -1):
        lead = jumps[k].select("id", "up").filter(F.col("up").isNotNull())
        far = walk.join(lead, "id").select("path", F.col("up").alias("id"), (F.col("steps") + (1 << k)).alias("steps"), "length")
        walk = materialise(walk.unionByName(far), "walk")
    return walk.select("path", (F.col("length") - 1 - F.col("steps")).alias("place"), "id")


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path: tree, path, n_turns, formatted, loss_spans."""
    messages = materialise(one_each(messages), "said")
    paths = _paths(messages, branches)
    turns = paths.join(messages.select("id", "tree", "role", "text"), "id").groupBy("path").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))

    def step(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, out = b.slice(i, 256), []
                for turns in part.column("turns").to_pylist():
                    text, spans = format_turns([(t["role"] or "", t["text"] or "") for t in turns])
                    out.append((len(turns), text, [{"start": a, "end": z} for a, z in spans]))
                yield pa.RecordBatch.from_arrays([part.column("tree"), *(pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))))], ["tree", "n_turns", "formatted", "loss_spans"])

    return turns.select("tree", "turns").mapInArrow(step, "tree string, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """format_paths over linear conversations: conv_id, n_turns, formatted, loss_spans."""
    return format_paths(from_turns(conversations)).withColumn("tree", F.col("tree").cast("long")).withColumnRenamed("tree", "conv_id")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from the formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def step(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(step, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
