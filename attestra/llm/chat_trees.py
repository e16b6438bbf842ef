"""Chat formatting from reply trees, with DataFrame functions only.

Messages name their parent. Self-joins of jump pointers enumerate root-to-leaf paths in a logarithmic number of
rounds: each round a message learns its ancestor twice as far up, with the score of the stretch between. Leaves are
ranked by the mean score of their path, and the chosen leaves' paths are collected back down the same pointers.
Only ids and scores take part in the joins; texts are joined once, to the chosen paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import stored

#: Marks of a turn, and the escapes that keep them out of roles and texts; a backslash in a text is escaped too.
OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
ESCAPES = {"\\": "\\b", "#": "\\h", "<": "\\l", ":": "\\c"}
#: Doublings after which the largest tree is counted, so as to know a cycle of parents from a long path.
LONG = 7


def escape(text: Column) -> Column:
    for a, b in ESCAPES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def best_paths(messages: DataFrame, per_tree: int | None = 1, unique: bool = False) -> DataFrame:
    """(tree_id, path, mean_score, msg_id, depth): the messages of the per_tree best root-to-leaf paths of each tree.

    messages: tree_id, msg_id, parent_id (null at a root), score (double). Of rows that repeat a message's ids the
    smallest parent counts (null first), then the smallest score; unique says that there are none. Messages without
    msg_id have no place in a tree and are left out. A parent that doesn't exist makes its child a root; of parents
    that form a cycle the smallest msg_id is a root. Null scores count as 0; equal mean scores are decided by the
    longer path, then the smaller leaf id. per_tree None keeps every path. A tree may have several roots.
    """
    m = messages.where("msg_id is not null").select("tree_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    if not unique:
        m = m.groupBy("tree_id", "msg_id").agg(F.min(F.struct("parent_id", "score")).alias("m")).select("tree_id", "msg_id", "m.*")
    known = m.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("p"))
    m = m.join(known, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("p")), "left")
    columns = ["tree_id", "msg_id", "parent_id", "up", "score", "n", "low"]
    at = stored(m.withColumn("up", F.col("p")).withColumn("n", F.lit(1).cast("long")).withColumn("low", F.col("msg_id")).select(columns), "tree")
    whole, largest = at, None
    # Round r: up is the ancestor 2**r above; score, n and low (the least id) cover the message and those below that
    # ancestor. Messages whose stretch reaches a root are done and only looked up from then on.
    done, open_, jumps = at.where("up is null"), at.where("up is not null"), []
    while not open_.isEmpty():
        if len(jumps) >= LONG and largest is None:
            largest = whole.groupBy("tree_id").count().agg(F.max("count")).first()[0]
        if largest is not None and 1 << len(jumps) > largest:
            return best_paths(_cut(whole, open_), per_tree, unique=True)
        jumps.append(open_.select("tree_id", "msg_id", "up"))
        a, b = open_.alias("a"), done.union(open_).alias("b")
        on = F.col("a.tree_id").eqNullSafe(F.col("b.tree_id")) & (F.col("a.up") == F.col("b.msg_id"))
        both = lambda c: (F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c)
        at = a.join(b, on).select("a.tree_id", "a.msg_id", "a.parent_id", "b.up", both("score"), both("n"), F.least("a.low", "b.low").alias("low"))
        at = stored(at, "tree")
        done, open_ = done.union(at.where("up is null")), at.where("up is not null")
    parents = done.select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).where("p is not null").distinct()
    leaves = done.join(parents, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("p")), "left_anti")
    leaves = leaves.withColumn("mean_score", F.col("score") / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("mean_score"), F.desc("n"), "msg_id"))
    leaves = leaves.withColumn("path", rank)
    if per_tree is not None:
        leaves = leaves.where(F.col("path") <= per_tree)
    on_path = leaves.select("tree_id", "path", "mean_score", "msg_id", F.col("n").alias("depth"))
    # Down the pointers, widest first: each message found so far adds the ancestor 2**r above it.
    for r in range(len(jumps) - 1, -1, -1):
        a, b = on_path.alias("a"), jumps[r].alias("b")
        on = F.col("a.tree_id").eqNullSafe(F.col("b.tree_id")) & (F.col("a.msg_id") == F.col("b.msg_id"))
        more = a.join(b, on).select("a.tree_id", "a.path", "a.mean_score", F.col("b.up").alias("msg_id"), (F.col("a.depth") - (1 << r)).alias("depth"))
        on_path = stored(on_path.union(more), "paths")
    return on_path


def _cut(tree: DataFrame, lost: DataFrame) -> DataFrame:
    """Messages of tree, without the parent of the smallest message of each cycle.

    lost: messages that reach no root, after so many doublings that a stretch is longer than any tree. Their `up` then
    are the members of cycles, and a member's stretch has its whole cycle and nothing else.
    """
    on_cycle = lost.select("tree_id", F.col("up").alias("msg_id")).distinct().alias("c")
    m = lost.alias("m").join(on_cycle, F.col("m.tree_id").eqNullSafe(F.col("c.tree_id")) & (F.col("m.msg_id") == F.col("c.msg_id")), "left_semi")
    roots = stored(m.where("msg_id = low").select(F.col("tree_id").alias("t"), F.col("msg_id").alias("i")), "roots")
    out = tree.join(roots, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("i")), "left")
    return out.select("tree_id", "msg_id", F.when(F.col("i").isNull(), F.col("parent_id")).alias("parent_id"), "score")


def format_paths(messages: DataFrame, paths: DataFrame, trained: tuple[str, ...] = ("assistant",), unique: bool = False) -> DataFrame:
    """One conversation for each path: (tree_id, path, n_turns, formatted, loss array<struct<start, length>>).

    messages: tree_id, msg_id, role, text. A turn reads `### ROLE:`, a line break, the text and `</turn>` with
    a line break; roles and texts are escaped, null ones are empty. Of rows that repeat a message's ids the smallest role,
    then the smallest text counts; unique says that there are none. loss lists the code points of the formatted
    string that hold the (escaped) text of a trained role, in order. Offsets are running sums over turns, so a
    long conversation costs no more than its length.
    """
    m = messages.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("i"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not unique:
        m = m.groupBy("t", "i").agg(F.min(F.struct("role", "text")).alias("m")).select("t", "i", "m.*")
    turns = paths.join(m, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("i")))
    turns = turns.select("tree_id", "path", "depth", F.col("role").isin(*trained).alias("on"), F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("body"))
    w = Window.partitionBy("tree_id", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    long = F.length("head") + F.length("body") + len(CLOSE)
    turns = turns.withColumn("start", F.coalesce(F.sum(long).over(w), F.lit(0)) + F.length("head"))
    turn = F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("said"), F.when(F.col("on"), F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"))
    out = turns.groupBy("tree_id", "path").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return out.select("tree_id", "path", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.said", "").alias("formatted"), F.filter("turns.loss", lambda x: x.isNotNull()).alias("loss"))


def chain(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A flat conversation as a tree without branches: (tree_id, msg_id, parent_id, score, role, text).

    Rows of a key are numbered by order, with role and text deciding ties; null keys form one conversation.
    """
    n = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.col(order).asc_nulls_first(), "role", "text"))
    out = rows.select(F.col(key).cast("long").alias("tree_id"), F.col(order), F.col("role").cast("string"), F.col("text").cast("string")).withColumn("msg_id", n)
    return out.select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), F.lit(1.0).alias("score"), "role", "text")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; no mark can occur inside an escaped text."""
    turns = F.filter(F.split(formatted, r"</turn>\n"), lambda x: x != "")
    return F.transform(turns, lambda x: F.struct(unescape(F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), MIDDLE, 1)).alias("role"), unescape(F.substring(x, F.instr(x, MIDDLE) + len(MIDDLE), F.length(x))).alias("text")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between the spans."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
