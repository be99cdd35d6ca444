"""Reply trees as conversations: paths by self-joins, branches ranked by score, one text for each path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starboard.llm.common import stored

# The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """Text in which no control string can begin: a backslash is doubled, and one is put into "<|"."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    """As ``escaped``, and on one line: a line feed is a backslash and n."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    """What was escaped. Doubled backslashes are set apart first, so that each other one is an escape of its own."""
    parts = F.split(text, r"\\\\")
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def with_ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes with ``depth`` (1 for a root) and ``total`` score of their path, and the ancestors 1, 2, 4, ... above.

    Each round joins the nodes that have not reached their root with all nodes and doubles the reach, so a path of
    n nodes takes log2(n) rounds, and short ones soon drop out. A parent that is not there makes a root. Nodes that
    lead into a circle never reach a root and are left out.
    """
    ids = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    here = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))
    found = nodes.join(ids, here, "left")
    state = stored(
        found.select(
            "tree",
            "node",
            F.col("n").alias("up"),
            F.lit(1).cast("long").alias("depth"),
            F.col("score").alias("total"),
        ),
        "ancestors",
    )
    most = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reached, active = state.where("up IS NULL"), state.where("up IS NOT NULL")
    levels, reach = [], 1
    while reach <= most and not active.isEmpty():
        levels.append(active.select("tree", "node", "up"))
        above = reached.unionByName(active).select(
            F.col("tree").alias("t"),
            F.col("node").alias("n"),
            F.col("up").alias("up2"),
            F.col("depth").alias("d"),
            F.col("total").alias("s"),
        )
        further = active.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        state = stored(
            further.select(
                "tree",
                "node",
                F.col("up2").alias("up"),
                (F.col("depth") + F.col("d")).alias("depth"),
                (F.col("total") + F.col("s")).alias("total"),
            ),
            "ancestors",
        )
        reached, active = reached.unionByName(state.where("up IS NULL")), state.where("up IS NOT NULL")
        reach *= 2
    return reached.drop("up"), levels


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """``tree``, ``leaf``, ``rank`` (from 1), ``node`` and ``depth`` for the best paths from a root to a leaf of each tree.

    Paths rank by the mean score of their messages, then longer ones first, then by leaf. All are returned if
    ``branches`` is None.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    reached, levels = with_ancestors(nodes)
    # A message with very many replies is one row here.
    parents = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = reached.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    paths = stored(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", "depth"), "paths")
    for reach, level in reversed(list(enumerate(levels))):
        above = level.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        higher = paths.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        higher = higher.select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << reach)).alias("depth"))
        paths = stored(paths.unionByName(higher), "paths")
    return paths


def format_trees(messages: DataFrame, *, branches: int | None = None, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row for each chosen path: ``tree``, ``leaf``, ``rank``, ``n_turns``, ``formatted`` and ``loss_spans``.

    ``messages`` has ``tree``, ``node``, ``parent`` (null for a root), ``role``, ``text`` and ``score``; a null score
    is 0, null role and text are empty, a null tree is a tree, rows with a null node are left out, and of rows with
    the same node the first by parent, role and text counts. Control strings in roles and texts are escaped.
    ``loss_spans`` are the code points (``start`` from 0, ``length``) of the escaped texts of ``loss_roles``, in order.
    Other columns are not read. No messages give no rows. Texts are taken whole; a path is one row, so that it has to
    fit into a task's memory. With ``branches=None`` a tree gives all its paths, so that a message comes once for each leaf
    below it: in a long chain with a reply to each message that is the square of its length. Name a number for such trees.
    """
    first = Window.partitionBy("tree", "node").orderBy("parent", "role", "text")
    messages = messages.where("node IS NOT NULL").withColumn("_first", F.row_number().over(first)).where("_first = 1")
    messages = stored(messages.drop("_first"), "messages")
    paths = reply_paths(messages, branches)
    content = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths.join(content, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = turns.select(
        "tree", "leaf", "rank", "depth", role.isin(*loss_roles).alias("_loss"),
        F.concat(F.lit(START), escaped_role(role), F.lit("\n")).alias("_head"), escaped(text).alias("_body"),
    )
    turns = turns.withColumn("_turn", F.concat("_head", "_body", F.lit(END)))
    so_far = Window.partitionBy("tree", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("_turn")).over(so_far), F.lit(0)) + F.char_length("_head")
    span = F.struct(start.alias("start"), F.char_length("_body").cast("long").alias("length"))
    turns = turns.select("tree", "leaf", "rank", "depth", "_turn", F.when(F.col("_loss"), span).alias("_span"))
    gathered = turns.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("depth", "_turn", "_span"))).alias("_turns")
    )
    return gathered.select(
        "tree", "leaf", "rank",
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: t["_turn"]), "").alias("formatted"),
        F.filter(F.transform("_turns", lambda t: t["_span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def linear_tree(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of plain conversations: each row replies to the one before it, by turn, role and text."""
    by = Window.partitionBy(conversation).orderBy(turn, "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(by).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select(
        F.col(conversation).alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def shared_tree(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of plain conversations as trees: those that begin alike share their first messages, then they branch.

    A message is named by a 64-bit hash of all roles and texts up to it, a tree by its first message; its score is
    the number of conversations that go through it. Null role and text are empty. Rows are put in order by turn, role, text.
    """
    said = F.struct(F.col(turn), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy(conversation).agg(F.array_sort(F.collect_list(said)).alias("said"))
    node = F.struct(F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("").alias("role"), F.lit("").alias("text"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array_remove(F.array(node), node).alias("nodes"))

    def further(state: Column, s: Column) -> Column:
        here = F.xxhash64(state["last"], s["role"], s["text"])
        added = F.struct(here.alias("node"), state["last"].alias("parent"), s["role"].alias("role"), s["text"].alias("text"))
        return F.struct(here.alias("last"), F.concat(state["nodes"], F.array(added)).alias("nodes"))

    nodes = F.aggregate("said", start, further)["nodes"]
    each = whole.select(nodes.alias("nodes")).select(F.get("nodes", F.lit(0))["node"].alias("tree"), F.inline("nodes"))
    # Combined before the shuffle, so that an opening that many conversations share is one row for each task.
    return each.groupBy("tree", "node", "parent").agg(
        F.min("role").alias("role"), F.min("text").alias("text"), F.count(F.lit(1)).cast("double").alias("score")
    )


def read_back(formatted: Column) -> Column:
    """Array of ``role`` and ``text`` of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda t: t != "")

    def parsed(t: Column) -> Column:
        inner = F.substr(t, F.lit(len(START) + 1))
        line = F.instr(inner, "\n")
        return F.struct(
            unescaped(F.substr(inner, F.lit(1), line - 1)).alias("role"), unescaped(F.substr(inner, line + 1)).alias("text")
        )

    return F.transform(turns, parsed)
