"""Chat formatting: reply trees, root-to-leaf paths, branches ranked by score, one conversation per chosen path.

Messages name their parent; a leaf and its ancestors are one path. Paths are enumerated by self-joins that double their
reach: round k knows every message's ancestor 2^k steps up, so a path of n messages takes log2(n) rounds.

A turn is written ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and texts get a backslash after their
first sign, and those that hold backslashes there already get one more, so reading back is exact and other texts stay as
they are. The loss mask is the spans (code points) of assistant texts in the formatted conversation.

Defined results: null roles and texts count as empty; a parent that does not exist makes a root; messages on or below a
cycle have no root and no path; of repeated (conv_id, msg_id) the smallest (role, text) counts; equal scores rank by the
smaller leaf id; null scores count as 0; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, stored

_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
LOSS_ROLE = "assistant"


def escape(text: str | None) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text) if text else ""


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans of it that count for the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """What format_turns wrote."""
    turns = []
    for part in formatted.split("</s>")[:-1]:
        role, _, text = part.removeprefix("<s>[INST]").partition("[/INST]")
        turns.append((unescape(role), unescape(text)))
    return turns


def chain(conversations: DataFrame) -> DataFrame:
    """Turns in order (ties by role, then text) as messages, each the reply to the one before."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("msg_id"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).cast("long")
    return numbered.select("conv_id", "msg_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv_id, leaf_id, back, msg_id): each chosen leaf with its ancestors, back steps up from the leaf.

    messages need conv_id, msg_id, parent_id, score. The keep best branches of a conversation are chosen (None: all), by
    the mean score along the path.
    """
    node = F.struct(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"))
    tree = messages.groupBy(node.alias("n")).agg(F.min("parent_id").alias("p"), F.max(F.coalesce("score", F.lit(0.0))).alias("w"))
    tree = stored(tree.where("n.m IS NOT NULL"), "tree")
    above = F.struct(F.col("n.c").alias("c"), F.col("p").alias("m"))
    known = tree.select(F.col("n").alias("a"))
    jump = tree.where("p IS NOT NULL").select("n", above.alias("a")).join(known, "a", "left_semi").select("n", "a")
    jumps, n = [stored(jump, "jump")], tree.count()
    while not jumps[-1].isEmpty() and 2 ** len(jumps) <= 2 * n:
        last = jumps[-1]
        further = last.select("n", F.col("a").alias("via")).join(last.select(F.col("n").alias("via"), "a"), "via")
        jumps.append(stored(further.select("n", "a"), "jump"))
    rootless = jumps[-1].select("n").distinct()  # still climbing after more steps than there are messages
    parents = jumps[0].select(F.col("a").alias("n")).distinct()
    leaves = tree.select("n").join(parents, "n", "left_anti").join(rootless, "n", "left_anti")
    path = stored(leaves.select(F.col("n").alias("leaf"), "n", F.lit(0).cast("long").alias("back")), "path")
    for k, jump in enumerate(jumps[:-1]):
        more = path.join(jump, "n").select("leaf", F.col("a").alias("n"), (F.col("back") + (1 << k)).alias("back"))
        path = stored(path.union(more), "path")
    if keep is not None:
        mean = path.join(tree.select("n", "w"), "n").groupBy("leaf").agg(F.avg("w").alias("w"))
        best = W.partitionBy("leaf.c").orderBy(F.col("w").desc(), F.col("leaf.m"))
        chosen = mean.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select("leaf")
        path = path.join(chosen, "leaf", "left_semi")
    return path.select(
        F.col("leaf.c").alias("conv_id"), F.col("leaf.m").alias("leaf_id"), "back", F.col("n.m").alias("msg_id")
    )


_TURNS = "array<struct<back:long,role:string,text:string>>"


def conversations(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv_id, leaf_id, formatted, loss): one row per chosen path; loss is an array of (start, end)."""
    chosen = paths(messages, keep)
    unique = messages.groupBy("conv_id", "msg_id").agg(F.min(F.struct("role", "text")).alias("x"))
    unique = unique.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "x.role", "x.text")
    grouped = (
        chosen.join(unique, _same("conv_id", "c") & (F.col("msg_id") == F.col("m")))
        .groupBy("conv_id", "leaf_id")
        .agg(F.collect_list(F.struct("back", "role", "text")).alias("turns"))
    )
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch):
        texts, masks = [], []
        for turns in batch.column("turns").to_pylist():
            turns.sort(key=lambda t: -t["back"])
            text, spans = format_turns([(t["role"], t["text"]) for t in turns])
            texts.append(text)
            masks.append([{"start": a, "end": b} for a, b in spans])
        columns = [batch.column("conv_id"), batch.column("leaf_id"), pa.array(texts, pa.string()), pa.array(masks, pair)]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "leaf_id", "formatted", "loss"])

    kinds = dict(grouped.dtypes)
    schema = f"conv_id {kinds['conv_id']}, leaf_id {kinds['leaf_id']}, formatted string, loss array<struct<start:long,end:long>>"
    return map_arrow(grouped, run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from what conversations() wrote: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batch):
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))
        for conv, text, loss in zip(*columns, strict=True):
            turns = read_turns(text)
            said = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
            learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            rows.append((conv, len(turns), sha(said), len(learned), sha(learned.encode()), len(text)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    kind = dict(formatted.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_arrow(formatted.select("conv_id", "formatted", "loss"), run, schema)
