r"""Chat formatting of reply trees, in DataFrame operations alone.

Messages name their parents. Ancestors are found by pointer doubling: self-joins give each
node's ancestor 1, 2, 4, ... steps up, and each leaf gathers its path by joining what it has
with the next table, so the number of joins follows the logarithm of the depth. Branches are
ranked by score, and each chosen path is one formatted conversation.

A turn is `### Role: text`, a line end, `</turn>` and a line end. A backslash goes before
each backslash, `###` and `</turn>` of a text, and before each backslash, colon, `#`, `<` and
line end of a role; dropping the first of two characters that begin with a backslash gives
both back. An escaped text never holds a line end followed by `</turn>`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselens.llm.common import ready
from caselens.session import stored

#: Fixed values of the template.
END = "\n</turn>\n"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"(\\|###|</turn>)", r"\\$1")


def escape_role(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\:#<\n])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


# -- reply trees -------------------------------------------------------------------------------


def reply_paths(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """(tree, leaf, node, steps): every node on the way from each leaf to its root, with its
    steps from the leaf; only for leaves that reach a root.

    A node whose parent is null or missing is a root. (tree, node) must tell nodes apart.
    Nodes on a ring, and leaves hanging from one, reach no root and are left out.
    """
    own = nodes.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p"))
    known = own.select(F.col("t").alias("t2"), F.col("n").alias("n2"))
    links = stored(own.join(known, own["t"].eqNullSafe(known["t2"]) & (own["p"] == known["n2"]), "left_semi"), "links")
    used = links.select(F.col("t").alias("t2"), F.col("p").alias("p2")).distinct()
    leaves = own.join(used, own["t"].eqNullSafe(used["t2"]) & (own["n"] == used["p2"]), "left_anti")
    paths = stored(leaves.select("t", F.col("n").alias("leaf"), "n", F.lit(0).cast("long").alias("steps")), "paths")
    jumps, step = links, 1
    for _ in range(max(1, math.ceil(math.log2(max(2, nodes.count()))) + 1)):  # no path is longer than the nodes; rings end here
        if jumps.isEmpty():
            break
        j = jumps.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("p").alias("up"))
        further = paths.join(j, paths["t"].eqNullSafe(j["t2"]) & (paths["n"] == j["n2"])).select("t", "leaf", F.col("up").alias("n"), (F.col("steps") + step).alias("steps"))
        paths = stored(paths.unionByName(further), "paths")
        jumps = stored(jumps.join(j, jumps["t"].eqNullSafe(j["t2"]) & (jumps["p"] == j["n2"])).select("t", "n", F.col("up").alias("p")), "jumps")
        step *= 2
    rooted = paths.join(links.select(F.col("t").alias("t2"), F.col("n").alias("n2")), paths["t"].eqNullSafe(F.col("t2")) & (paths["n"] == F.col("n2")), "left_anti")
    rooted = rooted.select(F.col("t").alias("t3"), F.col("leaf").alias("leaf3"))
    kept = paths.join(rooted, paths["t"].eqNullSafe(F.col("t3")) & (paths["leaf"] == F.col("leaf3")), "left_semi")
    return kept.select(F.col("t").alias(tree), "leaf", F.col("n").alias(node), "steps")


def chosen_branches(paths: DataFrame, nodes: DataFrame, tree: str, node: str, score: str, top: int | None) -> DataFrame:
    """(tree, leaf, branch_score, branch_rank): each tree's `top` paths by the mean score of
    their nodes, ties by the smaller leaf; all paths where top is None. Null scores count 0."""
    s = nodes.select(F.col(tree).alias("t2"), F.col(node).alias("n2"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"))
    scored = paths.join(s, paths[tree].eqNullSafe(s["t2"]) & (paths[node] == s["n2"])).groupBy(tree, "leaf").agg(F.avg("s").alias("branch_score"))
    if top == 1:  # a maximum is pre-aggregated; no tree's branches meet in one task
        best = scored.groupBy(tree).agg(F.min(F.struct((-F.col("branch_score")).alias("s"), F.col("leaf"))).alias("b"))
        return best.select(tree, F.col("b.leaf").alias("leaf"), (-F.col("b.s")).alias("branch_score"), F.lit(1).alias("branch_rank"))
    ranked = scored.withColumn("branch_rank", F.row_number().over(Window.partitionBy(tree).orderBy(F.desc("branch_score"), "leaf")))
    return ranked if top is None else ranked.filter(F.col("branch_rank") <= top)


def _parts(turns: Column) -> Column:
    """Head, escaped body and whether it is learned, for each of an array of turns."""
    return F.transform(turns, lambda x: F.struct(F.concat(F.lit("### "), escape_role(x["role"]), F.lit(": ")).alias("head"), escape_text(x["text"]).alias("body"), (x["role"] == "assistant").alias("learn")))


def conversations(nodes: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str, top: int | None = 1) -> DataFrame:
    """(tree, leaf, branch_score, branch_rank, formatted, loss_spans): a row for each chosen path.

    loss_spans: (start, end) of each assistant text in `formatted`, in code points. Null
    roles and texts count as empty; an empty table gives no rows.
    """
    ready(nodes.sparkSession)
    paths = reply_paths(nodes, tree, node, parent)
    chosen = chosen_branches(paths, nodes, tree, node, score, top)
    c = chosen.select(F.col(tree).alias("t2"), F.col("leaf").alias("leaf2"), "branch_score", "branch_rank")
    body = nodes.select(F.col(tree).alias("t3"), F.col(node).alias("n3"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = paths.join(c, paths[tree].eqNullSafe(c["t2"]) & (paths["leaf"] == c["leaf2"])).join(body, paths[tree].eqNullSafe(body["t3"]) & (paths[node] == body["n3"]))
    turns = rows.groupBy(paths[tree], "leaf").agg(F.first("branch_score").alias("branch_score"), F.first("branch_rank").alias("branch_rank"), F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "role", "text"))).alias("turns"))
    t = turns.select(tree, "leaf", "branch_score", "branch_rank", _parts(F.col("turns")).alias("parts"))
    ends = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("at"),
            F.when(x["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return t.select(tree, "leaf", "branch_score", "branch_rank", F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), ends.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The (role, text) structs that a formatted conversation holds."""
    segments = F.filter(F.split(formatted, r"\n</turn>\n"), lambda x: x != "")
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+): "

    def turn(x: Column) -> Column:
        role = F.regexp_extract(x, head, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, F.length(role) + F.lit(7), F.length(x))).alias("text"))

    return F.transform(segments, turn)


# -- rows by turn ------------------------------------------------------------------------------


def as_reply_chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, node, parent, role, text, score): each row answers the one before it by turn;
    rows of one turn follow each other by role and text, null turns come first. A null
    conversation is one of its own. The score is the length of an assistant's text."""
    slim = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    out = slim.withColumn("node", at)
    return out.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double").alias("score"))


#: The text of the added conversation. Fixed value.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    nodes = stored(as_reply_chains(rows.unionByName(hard)), "nodes")
    done = conversations(nodes, "conv", "node", "parent", "role", "text", "score")
    done = done.select("conv", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + F.lit(1), (s["end"] - s["start"]).cast("int")))), "")
    return done.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL
  SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(regexp_replace(role, '([\\:#<\n])', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 6 + 9 AS size FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
