"""Parent-child rows to full hierarchies, by pointer doubling.

Every node starts with a pointer to its parent. A round joins each unresolved node to
the node it points at and takes over that node's pointer, so the distance covered
doubles; a node is resolved once its pointer has run off a root. Nodes of depth d are
resolved after about log2(d) rounds. Nodes of each smaller depth are resolved earlier, so
a round that resolves nobody proves that the rest never reach a root: they stand on a
cycle or below one.

Each round is one equi-join whose right side has one row per node, and one job: resolved
nodes are set apart and not written again, and the open ones are counted while they are
written. A parent that holds a large share of all children is a hot key of the left side
only, which adaptive skew joins split; no group is ever gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillspan.runtime import cut

STRIP = r"(?U)^[\s<]+|[\s>]+$"


def node_name(iri: Column) -> Column:
    """The name by which an identifier is compared, whatever its notation.

    Outer white space and angle brackets go, then everything up to the last ``/`` or
    ``#``; a compact ``prefix:local`` form meets its expanded ``prefix_local`` or
    ``prefixlocal`` form by leaving out the mark between letters and digits. Null, blank
    or bracket-only input gives null.
    """
    bare = F.regexp_replace(iri, STRIP, "")
    local = F.regexp_extract(bare, r"([^/#]*)$", 1)
    return F.nullif(F.regexp_replace(local, r"(?<=\p{L})[:_](?=\d+$)", ""), F.lit(""))


def hierarchy(
    rows: DataFrame,
    node: str = "iri",
    parent: str = "parent_iri",
    name=node_name,
    with_path: bool = True,
    with_cycles: bool = True,
    with_walk: bool = False,
) -> DataFrame:
    """One row per node: ``node, root, depth, status`` and, if asked for, ``path``.

    ``status`` is ``tree``, ``cycle`` (on a cycle) or ``below`` (leads into one); with
    ``with_cycles=False`` both of the latter read ``below``. ``path`` lists the nodes from
    the root to the node itself. Off the trees ``root`` is empty, ``depth`` -1 and
    ``path`` null. ``with_walk`` adds ``walk``, null on the trees: the nodes met from an
    off-tree node upwards, itself first, each once, so up to and around the cycle.

    Nulls: rows whose node is null or blank are no nodes. A parent that is null, blank or
    names no node makes a root. Repeated rows count once; of rows that give one node
    different parents the smallest non-null parent counts. Two spellings of one node keep
    a row each, and children join the smaller spelling. An empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    nodes = (
        rows.select(F.col(node).alias("_node"), F.col(parent).alias("_parent"))
        .withColumn("_key", name(F.col("_node")))
        .where(F.col("_key").isNotNull())
        .groupBy("_node", "_key")
        .agg(F.min(F.when(name(F.col("_parent")).isNotNull(), F.col("_parent"))).alias("_parent"))
        .withColumn("_up", name(F.col("_parent")))
    )
    nodes = cut(nodes)
    targets = nodes.groupBy(F.col("_key").alias("_t")).agg(F.min("_node").alias("_ptr"))
    start = nodes.join(targets, F.col("_up") == F.col("_t"), "left").select(
        F.col("_node").alias("node"),
        F.coalesce(F.col("_ptr"), F.col("_node")).alias("ptr"),
        F.when(F.col("_ptr").isNull(), 0).otherwise(1).alias("dist"),
        F.col("_ptr").isNull().alias("done"),
    )
    with_path = with_path or with_walk
    if with_path:
        start = start.withColumn("path", F.array("node"))
    rounds, left = [], -1
    open_ = start
    while left:
        # what this round resolved, and what it left open
        part, now = _counted(open_)
        rounds.append(part.where("done"))
        open_ = part.where(~F.col("done"))
        state = reduce(DataFrame.unionByName, [*rounds, open_])
        if now == left:
            break
        left = now
        open_ = _double(open_, state, with_path)
    on_cycle = None
    if left and with_cycles:
        # Images of the unresolved nodes shrink until they are the cycles themselves.
        open_ = state.where(~F.col("done")).select("node", "ptr")
        images = open_.select("ptr").distinct().count()
        while True:
            far = open_.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"))
            open_ = cut(open_.join(far, "ptr").select("node", F.col("next").alias("ptr")))
            now = open_.select("ptr").distinct().count()
            if now == images:
                break
            images = now
        on_cycle = open_.select(F.col("ptr").alias("node")).distinct().withColumn("_on", F.lit(True))
    out = state if on_cycle is None else state.join(on_cycle, "node", "left")
    if with_walk:
        out = out.join(_walks(state.where(~F.col("done")), left), "node", "left")
    status = F.when(F.col("done"), "tree")
    if on_cycle is not None:
        status = status.when(F.col("_on"), "cycle")
    columns = [
        "node",
        F.when(F.col("done"), F.col("ptr")).otherwise("").alias("root"),
        F.when(F.col("done"), F.col("dist")).otherwise(-1).cast("int").alias("depth"),
        status.otherwise("below").alias("status"),
    ]
    if with_path:
        columns.append(F.when(F.col("done"), F.reverse("path")).alias("path"))
    return out.select(*columns, *(["walk"] if with_walk else []))


def _walks(state: DataFrame, left: int) -> DataFrame:
    """``node, walk`` of the ``left`` unresolved nodes: doubled on until each walk meets a node again.

    A finished walk has all that is above its node, so one that runs into it is finished too.
    """
    again = F.size(F.array_distinct("walked")) < F.size("walked")
    walks = state.select("node", "ptr", F.col("path").alias("walked")).withColumn("closed", again)
    walks = walks.withColumn("walked", F.array_distinct("walked"))
    while left:
        far = walks.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("walked").alias("_walked"), F.col("closed").alias("_closed"))
        open_ = walks.where(~F.col("closed")).join(far, "ptr").select(
            "node", F.col("_ptr").alias("ptr"), F.concat("walked", "_walked").alias("walked"), "_closed"
        )
        jumped = open_.withColumn("closed", F.col("_closed") | again).drop("_closed").withColumn("walked", F.array_distinct("walked"))
        walks = cut(walks.where("closed").unionByName(jumped))
        left = walks.where(~F.col("closed")).count()
    return walks.select("node", F.col("walked").alias("walk"))


def _counted(part: DataFrame) -> tuple[DataFrame, int]:
    """The rows cut from their lineage, and how many are open, in one job."""
    seen = Observation()
    part = cut(part.observe(seen, F.count_if(~F.col("done")).alias("open")))
    return part, seen.get["open"]


def _double(open_: DataFrame, state: DataFrame, with_path: bool) -> DataFrame:
    """Each unresolved node takes over the pointer of the node it points at."""
    far = state.select(
        F.col("node").alias("ptr"),
        F.col("ptr").alias("_ptr"),
        F.col("dist").alias("_dist"),
        F.col("done").alias("_done"),
        *([F.col("path").alias("_path")] if with_path else []),
    )
    return open_.join(far, "ptr").select(
        "node",
        F.col("_ptr").alias("ptr"),
        (F.col("dist") + F.col("_dist")).alias("dist"),
        F.col("_done").alias("done"),
        *([F.concat("path", "_path").alias("path")] if with_path else []),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor, node, distance``: every node below each ancestor, from ``hierarchy`` paths.

    Nodes on or below a cycle have their rows from ``walk``: every other node that is met
    upwards from them is an ancestor, at its first distance, so the members of a cycle are
    ancestors of each other, none of itself. Without ``walk`` in ``tree`` they have no row.
    """
    upwards = F.reverse("path")
    if "walk" in tree.columns:
        upwards = F.coalesce(upwards, "walk")
    steps = tree.select("node", F.posexplode(upwards).alias("_at", "ancestor"))
    return steps.where("_at > 0").select("ancestor", "node", F.col("_at").cast("int").alias("distance"))
