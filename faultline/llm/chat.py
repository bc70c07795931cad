"""Conversations from reply trees.

Messages hang on the message they answer. Self-joins that double their reach find, in as
many rounds as the logarithm of the depth, every message's ancestors 1, 2, 4, ... steps up,
its depth and the sum of scores to the root. The leaves of a tree are ranked by the mean
score of their path; the chosen ones are expanded into root-to-leaf paths by the same jumps,
each ancestor exactly once. A path is formatted as one conversation.

Template: each turn is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. In role
and text a backslash is doubled and a backslash goes after the first sign of each control
string, so no control string is left and the original comes back by dropping one backslash
of each. The loss mask holds the spans of assistant texts, in code points of the output.

Scale: jumps move ids, never texts; texts join once the paths are chosen. A conversation is
one row of output, so the longest path must fit a row.

Nulls: a null role or text is empty, a null score is 0, a null tree id is a tree of its own.
A message whose parent does not exist is a root. Messages on a cycle, or below one, have no
root and are in no path. Repeated turns follow each other in order of role and text; of
repeated messages of a reply tree the least in role and text stays. Equal scores go to the
smaller leaf. Empty tables give no conversations. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.session import written

# Strings that chat models give a meaning to.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_as_tree(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a chain of replies: tree, node, parent, role, text, score."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long")).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"))


def _own(messages: DataFrame) -> DataFrame:
    """One row per message, with a tree key that is never null."""
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("null"))
    rows = messages.select(
        key.alias("_tree"), "tree", "node", "parent", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).filter("node IS NOT NULL")
    one = F.min(F.struct("role", "text", "parent", "score", "tree")).alias("m")
    return rows.groupBy("_tree", "node").agg(one).select("_tree", "node", "m.*")


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors 2^i steps up for i = 0, 1, ...; and depth and score sum to the root of every rooted node."""
    there = nodes.select("_tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    now = nodes.join(there, ["_tree", "parent"], "left").select(
        "_tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"),
        F.col("score").alias("sum"), F.lit(1).cast("long").alias("depth"))
    now = written(now, "reply-jumps")
    total = now.count()
    # Messages that have come to their root are done; only the others jump on.
    done, now = now.filter("up IS NULL"), now.filter("up IS NOT NULL")
    steps, reach = [], 1
    # A path is no longer than all messages, so pointers alive beyond that run in circles.
    while reach <= total and not now.isEmpty():
        steps.append(now.select("_tree", "node", "up"))
        far = now.unionByName(done).select("_tree", F.col("node").alias("up"), F.col("up").alias("_up"),
                                           F.col("sum").alias("_sum"), F.col("depth").alias("_depth"))
        moved = written(now.join(far, ["_tree", "up"]).select(
            "_tree", "node", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"),
            (F.col("depth") + F.col("_depth")).alias("depth")), "reply-jumps")
        done, now = done.unionByName(moved.filter("up IS NULL")), moved.filter("up IS NOT NULL")
        reach *= 2
    return steps, done.drop("up")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, position (from 0 at the root), node, role and text of the best ``branches`` paths of each tree."""
    nodes = written(_own(messages), "reply-nodes")
    steps, rooted = _jumps(nodes)
    answered = nodes.filter("parent IS NOT NULL").select("_tree", F.col("parent").alias("node"))
    leaves = rooted.join(answered, ["_tree", "node"], "left_anti")
    best = W.partitionBy("_tree").orderBy((F.col("sum") / F.col("depth")).desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    found = chosen.select("_tree", F.col("node").alias("leaf"), "rank", "depth", "node", F.lit(0).cast("long").alias("back"))
    for i, step in reversed(list(enumerate(steps))):
        more = found.join(step, ["_tree", "node"]).select(
            "_tree", "leaf", "rank", "depth", F.col("up").alias("node"), (F.col("back") + 2**i).alias("back"))
        found = written(found.unionByName(more), "reply-paths")
    return found.join(nodes.select("_tree", "node", "tree", "role", "text"), ["_tree", "node"]).select(
        "_tree", "tree", "leaf", "rank", (F.col("depth") - 1 - F.col("back")).alias("position"), "node", "role", "text")


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, formatted and loss (spans of code points, end exclusive) of every chosen path."""
    turns = paths(messages, branches).withColumns({
        "_head": F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), "_body": escape(F.col("text"))})
    turn = F.concat("_head", "_body", F.lit(f"{END}\n"))
    so_far = W.partitionBy("_tree", "leaf").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("_turn", turn).withColumn(
        "_from", F.coalesce(F.sum(F.length("_turn")).over(so_far), F.lit(0)) + F.length("_head"))
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(
        F.col("_from").alias("start"), (F.col("_from") + F.length("_body")).alias("end")))
    whole = turns.groupBy("_tree", "leaf", "rank").agg(
        F.first("tree").alias("tree"),
        F.sort_array(F.collect_list(F.struct("position", "_turn"))).alias("_turns"),
        F.sort_array(F.collect_list(span)).alias("loss"))
    return whole.select("tree", "leaf", "rank", F.array_join(F.transform("_turns", lambda t: t["_turn"]), "").alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    mark = lambda s: s.replace("|", r"\|")
    pieces = F.filter(F.split(formatted, f"{mark(END)}\n"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(
        unescape(F.substring_index(F.regexp_replace(x, f"^{mark(START)}", ""), SEP, 1)).alias("role"),
        unescape(F.regexp_replace(x, f"(?s)^.*?{mark(SEP)}", "")).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


_MARKS = ", ".join(f"'{c}'" for c in CONTROL)
# The template spelt out: the marks of a turn take 32 signs, each backslash and control string one more.
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, list_sum(list_transform([{_MARKS}, chr(92)], lambda m:
    (length(role) - length(replace(role, m, '')) + length(t) - length(replace(t, m, ''))) // length(m))) AS added FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t) AS told,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY turn, role, t), '') AS learned,
  CAST(sum(length(role) + length(t) + added + {len(START + SEP + END) + 1}) AS BIGINT) AS formatted_chars FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
"""
