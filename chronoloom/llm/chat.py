"""Reply trees as chat text, with DataFrame operations only.

Messages name their parent. Root-to-leaf paths are enumerated by self-joins that double in reach: after
k rounds a leaf knows its 2^k nearest ancestors, so that a thread of depth d takes log2(d) rounds and the
paths take no more rows than the output has turns. Branches are ranked by score within their tree, and
each chosen path becomes one conversation with a loss mask over the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ._spark import save

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings, with any number of escaping backslashes after the first character.
_CONTROL = r"<(\\*)\|(im_start|im_end)\|>"
_ESCAPED = r"<\\(\\*)\|(im_start|im_end)\|>"


def escape(text: Column) -> Column:
    """One more backslash in every control string; text without control strings stays as it is."""
    return F.regexp_replace(text, _CONTROL, r"<\\$1|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1|$2|>")


def escape_role(role: Column) -> Column:
    """Roles stand on a line of their own: a backslash becomes \\b and a line end \\n."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every root-to-leaf path of messages(tree, node, parent), `up` steps above its leaf.

    A message whose parent is null or missing is a root. (tree, node) must be unique. In a tree of n messages no
    path has n steps, so what still climbs after n steps goes round in a cycle: such trees have one row, whose
    leaf and node are null.
    """
    ids = messages.select("tree", "node", "parent")
    step = ids.where(F.col("parent").isNotNull()).join(ids.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
    size = ids.groupBy("tree").agg(F.count("*").alias("n"))
    step = save(step.select("tree", "node", F.col("parent").alias("above")).join(size, "tree"), "chat-parents")
    leaves = ids.join(step.select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    reach, cyclic = 1, step.where("false").select("tree")
    while not step.isEmpty():
        further = paths.join(step, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up"))
        paths = save(paths.unionByName(further), "chat-paths")
        twice = step.select("tree", F.col("node").alias("above"), F.col("above").alias("above2"))
        step = save(step.join(twice, ["tree", "above"]).select("tree", "node", F.col("above2").alias("above"), "n"), "chat-parents")
        reach *= 2
        if not (stuck := step.where(F.col("n") <= reach)).isEmpty():
            cyclic = save(cyclic.unionByName(stuck.select("tree")).distinct(), "chat-cycles")
            step = step.join(cyclic, "tree", "left_anti")
            paths = paths.join(cyclic, "tree", "left_anti")
    nowhere = F.lit(None)
    return paths.unionByName(cyclic.select("tree", *[nowhere.cast(paths.schema[c].dataType).alias(c) for c in ("leaf", "node")], nowhere.cast("long").alias("up")))


def chosen_branches(messages: DataFrame, paths: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, branch_score, branch): branches of a tree by mean message score, ties to the smaller leaf."""
    scored = paths.join(messages.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
    ranked = scored.withColumn("branch", F.row_number().over(W.partitionBy("tree").orderBy(F.col("branch_score").desc_nulls_last(), "leaf")))
    return ranked if branches is None else ranked.where(F.col("branch") <= branches)


def _identified(messages: DataFrame) -> DataFrame:
    """Messages with tree, node and parent as structs, which compare and join as null does not.

    Of rows that repeat a (tree, node) pair the first, by content, is the one that replies answer; the others are
    messages of their own that answer the same parent.
    """
    order = W.partitionBy("tree", "node").orderBy(*[F.col(c).asc_nulls_first() for c in ("parent", "role", "text", "score")])
    m = messages.select("tree", "node", "parent", "role", "text", F.col("score").cast("double").alias("score")).withColumn("copy", F.row_number().over(order))
    return m.select(
        F.struct("tree").alias("tree"), F.struct("node", "copy").alias("node"),
        F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("node"), F.lit(1).alias("copy"))).alias("parent"),
        "role", "text", "score",
    )


def format_chats(messages: DataFrame, *, branches: int | None = None, learn: str = "assistant") -> DataFrame:
    """One row per chosen path of messages(tree, node, parent, role, text, score).

    Columns: tree, leaf, branch, branch_score, formatted, turn_starts (code points, 0-based) and
    loss_spans: array of (turn, start, length) in code points, one for each turn of the role `learn`.
    Null role and text are empty, and a null tree is a tree like any other. Rows that repeat a (tree, node) pair
    are separate messages, of which the first by content has the replies; so are rows without node. A tree
    with a cycle of parents is set aside: one row with all columns but tree null. An empty table gives no rows.
    """
    messages = _identified(messages)
    paths = reply_paths(messages)
    whole = paths.where(F.col("leaf").isNotNull())
    chosen = chosen_branches(messages, whole, branches)
    turns = whole.join(chosen, ["tree", "leaf"]).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = turns.withColumns({"head": F.concat(F.lit(START), escape_role(role), F.lit("\n")), "body": escape(text), "learn": role == F.lit(learn)})
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    path = W.partitionBy("tree", "leaf").orderBy(F.col("up").desc())
    turns = turns.withColumns({
        "turn": F.row_number().over(path) - 1,
        "start": F.coalesce(F.sum(F.char_length("piece")).over(path.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"),
    })
    one = F.struct("turn", "piece", "start", F.char_length("head").cast("long").alias("head"), F.char_length("body").cast("long").alias("body"), "learn")
    rows = turns.groupBy("tree", "leaf", "branch", "branch_score").agg(F.array_sort(F.collect_list(one)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["turn"].alias("turn"), (x["start"] + x["head"]).alias("start"), x["body"].alias("length")))
    out = rows.select(
        F.col("tree.tree").alias("tree"), F.col("leaf.node").alias("leaf"), "branch", "branch_score",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("t", lambda x: x["start"]).alias("turn_starts"),
        spans.alias("loss_spans"),
    )
    aside = paths.where(F.col("leaf").isNull()).select(F.col("tree.tree").alias("tree"))
    return out.unionByName(aside, allowMissingColumns=True)


def read_chats(chats: DataFrame) -> DataFrame:
    """turns (array of role, text) and loss_texts (unescaped text under the mask), parsed from `formatted`."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    df = chats.withColumn("pieces", F.slice(parts, 1, F.size(parts) - 1))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(START) + 1, 2**31 - 1)
        head = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(head).alias("role"), unescape(body.substr(F.char_length(head) + 2, F.char_length(body))).alias("text"))

    def under_mask(span: Column) -> Column:
        piece = F.element_at("pieces", (span["turn"] + 1).cast("int"))
        begin = span["start"] - F.element_at("turn_starts", (span["turn"] + 1).cast("int"))
        return unescape(piece.substr((begin + 1).cast("int"), span["length"].cast("int")))

    return df.withColumns({"turns": F.transform("pieces", turn), "loss_texts": F.transform("loss_spans", under_mask)}).drop("pieces")


def linear_threads(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as messages: each turn answers the one before.

    Rows of one conversation go by turn (null first), then role and text, so that repeated turns have a fixed
    order and repeated rows stay separate turns. Rows without conv_id are one conversation, without tree.
    """
    order = W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
