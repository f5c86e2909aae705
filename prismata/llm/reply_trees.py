"""Chat formatting of reply trees, by DataFrame functions alone.

Method.  Messages of a tree point at the message they answer.  Iterative
self-joins double the reach of these links: round k joins the table of 2^k-step
links with itself, so a chain of n turns takes log2(n) rounds, and only messages
that have so many ancestors are still in it.  Leaves descend through the tables
from the longest steps on, which gives each its root, depth and the sum of scores
on its path; per root, leaves are ranked by the mean score of their path.  The
chosen leaves then climb the tables again: each round joins the nodes found so
far with the next table, which lists every root-to-leaf path as (leaf, node,
place) rows.

Each path becomes one conversation of segments ``(text, loss)``: an opening mark
with the role, the message, a closing mark.  The joined segments are the
formatted text; those with ``loss`` are the loss mask and cover the answers'
texts and nothing else.  Control strings inside texts and roles get one more
backslash behind their first character, which ``unescaped`` takes away again.

Messages are numbered inside their tree, so all tables of links hold small
integers.  Texts are shuffled once: the messages of a tree come together in the
order of their numbers, and its paths pick theirs by number.  Trees of more than
``TREE_MESSAGES`` messages or ``TREE_CHARS`` code points are not gathered: their
messages join their paths by message, and only the turns of one path come
together, as they are one value of the result.

Defined cases: a null tree is a tree of its own; a null text and a null role are
empty; a null score counts 0; a message whose parent is null or missing is a
root; repeated rows of one message are said one after the other; messages that
answer each other in a cycle raise an error; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ranks import ranked_in_order

OPEN, ROLE_END, CLOSE = "<s>", "[INST]", "[/INST]</s>"
#: Any of the marks' control strings, with the backslashes an escaped one has; regular expression of both engines.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
LEARNT = "assistant"
TREE_MESSAGES = 10_000
TREE_CHARS = 8_000_000
MOST_ROUNDS = 40

SEGMENTS = "array<struct<text:string,loss:boolean>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def steps(links: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up, sum) of the ancestors 1, 2, 4 ... steps up, while there are any; ``sum`` adds the scores from the node to below ``up``.

    ``links`` has (tree, node, up, sum) of single steps.
    """
    tables = [common.saved(links.where("up is not null"))]
    while tables[-1].limit(1).count():
        if len(tables) > MOST_ROUNDS:
            raise ValueError("messages answer each other in a cycle")
        low = tables[-1]
        high = low.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("higher"), F.col("sum").alias("more"))
        joined = low.join(high, (F.col("tree").eqNullSafe(F.col("t"))) & (F.col("up") == F.col("n")))
        tables.append(common.saved(joined.select("tree", "node", F.col("higher").alias("up"), (F.col("sum") + F.col("more")).alias("sum"))))
    return tables[:-1]


def _climbed(at: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """``at`` (tree, at, ...) with ``up`` and ``sum`` of the table's step from there."""
    table = table.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up", "sum")
    return at.join(table, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("n")), how).drop("t", "n")


def leaves(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """tree, leaf, root, depth (messages on the path) and score (their mean) of each message that nothing answers.

    ``nodes`` has (tree, node, score) of every message.
    """
    answered = tables[0].select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct() if tables else None
    ends = nodes if answered is None else nodes.join(answered, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    now = common.saved(ends.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(1).cast("long").alias("depth"), F.lit(0.0).alias("total")))
    for k in reversed(range(len(tables))):
        got = _climbed(now, tables[k], "left")
        now = got.select("tree", "leaf", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth"), (F.col("total") + F.coalesce("sum", F.lit(0.0))).alias("total"))
    roots = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    now = now.join(roots, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("n")))
    return now.select("tree", "leaf", F.col("at").alias("root"), "depth", ((F.col("total") + F.col("score")) / F.col("depth")).alias("score"))


def members(chosen: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """tree, leaf, node and turn (0 at the root) of every message on the paths of the chosen leaves."""
    found = chosen.select("tree", "leaf", "depth", F.col("leaf").alias("at"), F.lit(0).cast("long").alias("above"))
    for k, table in enumerate(tables):
        # a path has an ancestor 2^k steps above this node, or the node needs no join
        more = found.where(F.col("above") + (1 << k) < F.col("depth"))
        more = _climbed(more, table, "inner").select("tree", "leaf", "depth", F.col("up").alias("at"), (F.col("above") + (1 << k)).alias("above"))
        found = common.saved(found.unionByName(more)) if k + 1 < len(tables) else found.unionByName(more)
    return found.select("tree", "leaf", F.col("at").alias("node"), (F.col("depth") - 1 - F.col("above")).alias("turn"))


def paths(links: DataFrame, branches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ranked leaves, and the members of the paths of the ``branches`` best of each root (None: of all).

    ``links`` is a stored table of (tree, node, parent, score), one row for each message.
    """
    nodes = links.select("tree", "node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    single = links.where("parent is not null").select("tree", "node", F.col("parent").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum"))
    single = single.join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).drop("t", "n")
    tables = steps(single)
    ranked = ranked_in_order(leaves(nodes, tables), ["tree", "root"], [F.col("score").desc(), F.col("leaf")], "branch")
    ranked = common.saved(ranked if branches is None else ranked.where(F.col("branch") <= branches))
    return ranked, common.saved(members(ranked, tables))


def segments(turns: Column) -> Column:
    """The segments of an array of (turn, role, text)."""
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    one = lambda t: F.array(part(F.concat(F.lit(OPEN), escaped(t.role), F.lit(ROLE_END)), no), part(escaped(t.text), t.role == LEARNT), part(F.lit(CLOSE), no))
    return F.flatten(F.transform(turns, one)).cast(SEGMENTS)


def _by_tree(said: DataFrame, found: DataFrame) -> DataFrame:
    """(tree, leaf, turns): a tree's messages come together once, in the order of their numbers, and its paths pick theirs by number."""
    trees = said.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("key", "role", "text"))).alias("said"))
    asked = found.groupBy("of", "leaf").agg(F.array_sort(F.collect_list(F.struct("turn", "node"))).alias("places"))
    pick = lambda p: F.get(F.col("said"), p.node.cast("int"))
    return trees.join(asked, "of").select("of.tree", "leaf", F.transform(F.transform("places", pick), lambda m: F.struct(m.role.alias("role"), m.text.alias("text"))).alias("turns"))


def _by_message(said: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """(tree, leaf, turns) for trees too large to come together: a join by message, a group by path."""
    once = said.groupBy("of", "key").agg(F.first("role").alias("role"), F.first("text").alias("text"))  # rows of one key are equal
    places = found.join(links.select("of", "node", "key"), ["of", "node"]).select("of", "key", "leaf", "turn")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    met = once.join(places, ["of", "key"]).groupBy("of", "leaf").agg(turns.alias("turns"))
    return met.select("of.tree", "leaf", F.transform("turns", lambda m: F.struct(m.role.alias("role"), m.text.alias("text"))).alias("turns"))


def formatted(said: DataFrame, links: DataFrame, branches: int | None = None, tree_messages: int = TREE_MESSAGES, tree_chars: int = TREE_CHARS) -> DataFrame:
    """tree, leaf, branch, score and segments of each chosen path; ``said`` and ``links`` are those of ``of_messages``."""
    numbers = common.saved(links.select("tree", "node", "parent", "score"))
    ranked, found = paths(numbers, branches)
    # a struct equals itself though its tree is null, so one partitioning by it serves groups and joins
    said, links, found = (x.withColumn("of", F.struct("tree")) for x in (said, links, found))
    large = links.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).where((F.col("n") > tree_messages) | (F.col("chars") > tree_chars))
    large = common.saved(large.select("of"))
    turns = _by_tree(said.join(large, "of", "left_anti"), found.join(large, "of", "left_anti"))
    if large.limit(1).count():
        turns = turns.unionByName(_by_message(*[x.join(large, "of", "left_semi") for x in (said, links, found)]))
    told = ranked.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "branch", "score")
    if branches is not None:
        turns = turns.join(told, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")))
    return turns.select("tree", "leaf", *(["branch", "score"] if branches is not None else []), segments(F.col("turns")).alias("segments"))


def read_back(segments_: Column) -> dict[str, Column]:
    """turns (array of role, text) of the joined segments, and the text under the loss mask."""
    whole = F.array_join(F.transform(segments_, lambda s: s.text), "")
    pieces = F.filter(F.split(whole, r"\Q" + CLOSE + r"\E", -1), lambda p: F.length(p) > 0)
    body = lambda p: F.split(F.substr(p, F.lit(len(OPEN) + 1)), r"\Q" + ROLE_END + r"\E", 2)
    turn = lambda b: F.struct(unescaped(F.get(b, F.lit(0))).alias("role"), unescaped(F.get(b, F.lit(1))).alias("text"))
    learnt = F.array_join(F.transform(F.filter(segments_, lambda s: s.loss), lambda s: unescaped(s.text)), "")
    return {"formatted": whole, "turns": F.transform(F.transform(pieces, body), turn), "learnt": learnt}


def _keyed(messages: DataFrame, node: str) -> DataFrame:
    """``messages`` with ``key``, which orders them inside their tree; the digest stands for the text."""
    text = F.coalesce("text", F.lit(""))
    d = messages.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", text)
    return d.withColumn("key", F.struct(F.col(node).alias("node"), "role", F.sha2(text.cast("binary"), 256).alias("digest")))


def of_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, key, role, text) of messages in rows (tree, node, parent, role, text, score), and their links.

    Links are (tree, node, parent, score, chars, key): inside a tree, messages
    are numbered from 0 by node, role and text.  Rows of one (tree, node) answer
    each other in this order, and what answers the node answers the last of them.
    """
    m = common.with_columns(messages, tree="long", node="long", parent="long", role="string", text="string", score="double")
    m = _keyed(m, "node")
    inside = Window.partitionBy("tree").orderBy("key")
    thin = m.select("tree", "key", "parent", "score", F.length("text").alias("chars"))
    thin = thin.select("*", (F.row_number().over(inside) - 1).cast("long").alias("number"), F.lag("key.node").over(inside).alias("before"), F.lag(F.lit(True), 1, False).over(inside).alias("later"))
    last = thin.groupBy(F.col("tree").alias("t"), F.col("key.node").alias("n")).agg(F.max("number").alias("last"))
    met = thin.join(last, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    again = F.col("later") & F.col("before").eqNullSafe(F.col("key.node"))
    links = met.select("tree", F.col("number").alias("node"), F.when(again, F.col("number") - 1).otherwise(F.col("last")).alias("parent"), "score", "chars", "key")
    return m.select("tree", "key", "role", "text"), links


def of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of conversations in rows (conv_id, turn, role, text): each row answers the one before it.

    A null turn comes first; rows of one turn follow each other by role and the
    digest of their text.
    """
    c = _keyed(common.with_columns(conversations, conv_id="long", turn="long", role="string", text="string").withColumnRenamed("conv_id", "tree"), "turn")
    number = (F.row_number().over(Window.partitionBy("tree").orderBy("key")) - 1).cast("long")
    links = c.select("tree", "key", F.length("text").alias("chars")).select("tree", number.alias("node"), "chars", "key")
    links = links.select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(None).cast("double").alias("score"), "chars", "key")
    return c.select("tree", "key", "role", "text"), links


#: A conversation of its own that says the template's control strings.
CONTROL_ROWS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def report(conversations: DataFrame, **parameters) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation and of the control one, read back from the formatted paths."""
    spark = conversations.sparkSession
    c = common.with_columns(conversations, conv_id="long", turn="long", role="string", text="string")
    c = c.unionByName(spark.createDataFrame(CONTROL_ROWS, c.schema))
    got = formatted(*of_conversations(c), **parameters)
    back = read_back(F.col("segments"))
    got = got.select(F.col("tree").alias("conv_id"), *[v.alias(k) for k, v in back.items()])
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), sha(F.col("learnt")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
