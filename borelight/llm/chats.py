"""Reply trees as conversations: root-to-leaf paths by iterative self-joins, ranked branches, one formatted text each."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borelight.operators.materialise import materialised

START, END = "<|im_start|>", "<|im_end|>"  # fixed values: the control strings of the template
OPEN = re.compile(r"<(\\*)\|")
OPENED = re.compile(r"<(\\+)\|")
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
LEARNED = "assistant"


def escape(text: str) -> str:
    """Puts one more backslash between `<` and `|`, however many stand there, so that no control string can appear."""
    return OPEN.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return OPENED.sub(lambda m: "<" + m[1][1:] + "|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """A conversation as text, and the spans (code points) whose text is learned: what assistants say, control strings left out."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts.append(head + body + END + "\n")
        at += len(parts[-1])
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; an error if it is not one."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, place, node): the nodes of the `branches` best root-to-leaf paths of every tree, root first.

    `nodes` has tree, node, parent and score; (tree, node) is unique. Every round joins the table of ancestors with itself, which
    doubles their distance and adds up scores on the way, so a tree of depth d takes log2(d) rounds. Leaves are ranked by the
    mean score of their path, then the longer path, then the smaller leaf. The same tables, read again, list the ancestors of
    the chosen leaves alone. A parent that is not there makes a node a root; nodes that only lead round in a circle are on no
    path. A null score is 0.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    there = nodes.select("tree", F.col("node").alias("up"))
    linked = nodes.withColumnRenamed("parent", "up").join(there.withColumn("_there", F.lit(True)), ["tree", "up"], "left")
    level = materialised(linked.select("tree", "node", F.when(F.col("_there"), F.col("up")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")))
    leaves = nodes.select("tree", "node").join(nodes.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    levels, most = [], max(1, level.count()).bit_length() + 1
    for _ in range(most):
        hop = level.where("up is not null").select("tree", "node", "up")
        if hop.isEmpty():
            break
        levels.append(hop)
        far = level.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("steps").alias("s2"))
        level = level.join(far, ["tree", "up"], "left").select(
            "tree", "node", F.col("up2").alias("up"), (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"),
            (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"),
        )
        level = materialised(level)
    rank = Window.partitionBy("tree").orderBy((F.col("total") / F.col("steps")).desc(), F.desc("steps"), "node")
    best = leaves.join(level.where("up is null"), ["tree", "node"]).withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    found = materialised(best.select("tree", F.col("node").alias("leaf"), "branch", "node", F.col("steps").alias("place")))
    for k, hop in enumerate(levels):
        above = found.join(hop, ["tree", "node"]).select("tree", "leaf", "branch", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        found = materialised(found.unionByName(above))
    return found


def conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, formatted, loss) of the chosen paths. `nodes` also has role and text (null: empty)."""
    chosen = paths(nodes, branches)
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    grouped = chosen.join(said, ["tree", "node"]).groupBy("tree", "leaf", "branch").agg(turns)

    def write(batches):
        for batch in batches:
            rows = [format_turns([(t["role"], t["text"]) for t in x.as_py()]) for x in batch.column("turns")]
            loss = pa.array([[{"start": a, "end": b} for a, b in m] for _, m in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [batch.column("tree"), batch.column("leaf"), batch.column("branch"), pa.array([f for f, _ in rows], pa.string()), loss]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "branch", "formatted", "loss"])

    schema = "tree string, leaf long, branch int, formatted string, loss array<struct<start:long,end:long>>"
    return grouped.mapInArrow(write, schema)


def as_tree(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees of one branch: each row answers the one before it.

    Rows of a conversation go by turn (null first), equal turns by role, then text; equal rows each stay. A null conv_id is a
    conversation of its own.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.nullif(F.col("node") - 1, F.lit(0)).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them: turns, their digest, and the text under the loss mask."""

    def read(batches):
        for batch in batches:
            out = []
            for f, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parse_turns(f)
                learned = "".join(unescape(f[m["start"] : m["end"]]) for m in mask)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                sha = [hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for s in (whole, learned)]
                out.append((len(turns), sha[0], len(learned), sha[1], len(f)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            names = ["tree", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("branch"), *columns], names=names)

    schema = "tree string, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "branch", "formatted", "loss").mapInArrow(read, schema)


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """Every conversation formatted by its only branch and read back: conv_id and the digests. Null role or text: empty. No rows: no
    rows. Other columns are ignored. A conversation is one text and so stands in one task's memory."""
    done = digests(conversations(materialised(as_tree(turns))))
    return done.select(F.nullif("tree", F.lit("null")).cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
