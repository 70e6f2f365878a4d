"""Chat formatting of reply trees.

Messages form trees by parent links. Each round of a self-join doubles the distance of a jump link, so
a tree of depth d takes log2(d) rounds, and a round's table has one row for each message that
hasn't reached its root; along the way each message gains its depth and the summed score of its path. Leaves are ranked in
their tree by path score; the messages of a chosen path are found from its leaf by the same
jump tables, longest jumps first. A path is then formatted as one conversation.

The template writes a turn as `<turn>### role\\ntext</turn>\\n`. In roles and texts `&`, `<`, `#` and
(in roles) line feeds are written as character references, so no control string can come
from a text, and parsing reverses the escape exactly. The loss mask is the list of character spans of
assistant texts.

Defined results: null texts and roles are empty; rows of equal conversation and turn are ordered by
role and text; messages whose parent is missing are roots; a cycle has no root and gives no
path; null conversation ids form one conversation; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize

OPEN, CLOSE = "<turn>### ", "</turn>\n"


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ("#", "&#35;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("#", "&#35;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def chain(conversations: DataFrame) -> DataFrame:
    """Messages of a linear table (conv_id, turn, role, text): each turn replies to the one before."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("message_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return rows.select("conv_id", "message_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _jump(active: DataFrame, done: DataFrame) -> DataFrame:
    """Links (conv_id, message_id, up, gain, steps) that have an upper end, to twice the distance."""
    far = active.unionByName(done).select(F.col("conv_id").alias("c"), F.col("message_id").alias("m"), F.col("up").alias("up2"), F.col("gain").alias("gain2"), F.col("steps").alias("steps2"))
    joined = active.join(far, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("m")))
    return joined.select("conv_id", "message_id", F.col("up2").alias("up"), (F.col("gain") + F.col("gain2")).alias("gain"), (F.col("steps") + F.col("steps2")).alias("steps"))


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """messages: conv_id, message_id, parent_id, role, text, score. The rows of the best root-to-leaf
    paths of each conversation: conv_id, path (1 is best), step (0 is the root), role, text.

    Paths rank by the sum of their messages' scores, then length, then leaf id."""
    messages = materialize(messages.select("conv_id", "message_id", "parent_id", "role", "text", "score"), "chat-messages")
    ids = messages.select(F.col("conv_id").alias("c"), F.col("message_id").alias("m"))
    linked = messages.join(ids, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent_id") == F.col("m")), "left")
    links = materialize(linked.select("conv_id", "message_id", F.col("m").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("gain"), F.lit(1).cast("long").alias("steps")), "chat-links")
    jumps, active, done = [], links.filter("up is not null"), links.filter("up is null")
    left, before = active.count(), None
    # Each round ends messages as long as there are any that deep; what is left when none ends hangs on a cycle.
    while left and left != before:
        jumps.append(active)
        links = materialize(_jump(active, done), "chat-jumps")
        active, done = links.filter("up is not null"), done.unionByName(links.filter("up is null"))
        left, before = active.count(), left
    whole = done.drop("up")
    parents = linked.select(F.col("conv_id").alias("c"), F.col("m")).filter("m is not null").distinct()
    leaves = whole.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message_id") == F.col("m")), "left_anti")
    rank = Window.partitionBy("conv_id").orderBy(F.col("gain").desc(), F.col("steps").desc(), "message_id")
    chosen = leaves.withColumn("path", F.row_number().over(rank)).filter(F.col("path") <= best)
    on_path = materialize(chosen.select("conv_id", "path", "message_id", (F.col("steps") - 1).alias("step")), "chat-leaves")
    for k in reversed(range(len(jumps))):
        up = jumps[k].select(F.col("conv_id").alias("c"), F.col("message_id").alias("m"), "up")
        higher = on_path.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message_id") == F.col("m")))
        higher = higher.select("conv_id", "path", F.col("up").alias("message_id"), (F.col("step") - (1 << k)).alias("step"))
        on_path = on_path.unionByName(materialize(higher, "chat-path"))  # only new rows are written
    named = on_path.select(F.col("conv_id").alias("c"), "path", "step", F.col("message_id").alias("m"))
    joined = messages.join(named, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message_id") == F.col("m")))
    return joined.select("conv_id", "path", "step", "role", "text")


def render(turns: DataFrame) -> DataFrame:
    """One row a path: conv_id, path, formatted and loss_spans, an array of (start, end) in code points."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    text = escape(F.coalesce("text", F.lit("")))
    head, body = F.concat(F.lit(OPEN), role, F.lit("\n")), F.concat(text, F.lit(CLOSE))
    shown = turns.select("conv_id", "path", "step", F.concat(head, body).alias("shown"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learned"), F.length(head).cast("long").alias("head"), F.length(text).cast("long").alias("body"))
    before = F.sum(F.length("shown").cast("long")).over(Window.partitionBy("conv_id", "path").orderBy("step", "shown").rowsBetween(Window.unboundedPreceding, -1))
    placed = shown.withColumn("start", F.coalesce(before, F.lit(0)) + F.col("head"))
    whole = placed.groupBy("conv_id", "path").agg(F.array_sort(F.collect_list(F.struct("step", "shown", "start", "learned", "body"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["body"]).alias("end")))
    return whole.select("conv_id", "path", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    def one(part: Column) -> Column:
        inner = F.substr(part, F.lit(len(OPEN) + 1))
        end = F.instr(inner, F.lit("\n"))
        return F.struct(unescape(F.replace(F.substring(inner, F.lit(1), end - 1), F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(F.substr(inner, end + 1)).alias("text"))
    return F.transform(parts, one)


def learned(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """What a reader of the output finds, of each conversation."""
    read = rendered.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), learned(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
