"""Problem 3: parent-child rows to full hierarchies by heavy-path decomposition.

All steps work on long ids and double their reach each round, so a tree of depth D takes about
``log2(D)`` rounds and no step depends on the depth being known:

1. ids: every node gets one, parents are looked up once;
2. cycles: jump pointers are doubled until every node that has a root has met it; what is left leads
   into a loop and is set aside. The same rounds sum subtree sizes;
3. chains: a node's heavy child is the one with the largest subtree; nodes joined by heavy links form
   chains. Doubling along heavy links gives each node its chain's head, its position there and the
   chain segment from the head to it;
4. chain tree: chains hang under nodes of other chains, at most ``log2(N)`` deep. Doubling over it
   gives root, depth, the concatenated segments above a chain, and where its interval begins in the
   heavy-first order of the tree. A node's descendants are exactly the nodes with a position in
   ``[first_pos, last_pos]`` of its root's tree, its own chain's rest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glossloom.session import Scratch

#: Blocks into which the children of one parent are split for the running sum of subtree sizes.
SIBLING_BLOCKS = 256
#: Positions per block of a tree's order, by which intervals meet the nodes in them.
POSITION_BLOCK = 32


def _double(scratch: Scratch, state: DataFrame, add: dict[str, str]) -> DataFrame:
    """Pointer doubling: follow ``jump`` to the top, summing or concatenating the ``add`` columns.

    ``state`` has ``id``, ``jump`` (null at the top), ``top`` and the columns of ``add``, each mapped to
    ``sum`` or ``concat`` (an array, the upper part first). The links must be free of cycles. Rounds end
    when no pointer is left, as counted when ``state`` was saved.
    """
    while scratch.metric(state, "open"):
        up = state.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("top").alias("_top"), *[F.col(c).alias(f"_{c}") for c in add])
        open_, done = state.where("jump is not null"), state.where("jump is null")
        stepped = open_.join(up, F.col("jump") == F.col("_id")).select(
            "id", F.col("_jump").alias("jump"), F.col("_top").alias("top"),
            *[(F.col(c) + F.col(f"_{c}") if how == "sum" else F.concat(f"_{c}", c)).alias(c) for c, how in add.items()],
        )
        state = scratch.save(done.select(*stepped.columns).unionByName(stepped), [scratch.path(state)], open=F.count("jump"))
    return state


def _numbered(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``tree``, ``node``, ``id`` and ``pid`` of every node; an unknown parent counts as none."""
    named = links.where("tree is not null and node is not null")
    one = named.groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    ids = scratch.save(one.withColumn("id", F.monotonically_increasing_id()))
    up = ids.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("id").alias("pid"))
    out = ids.join(up, (F.col("tree") == F.col("_t")) & (F.col("parent") == F.col("_n")), "left")
    return scratch.save(out.select("tree", "node", "id", "pid"), [scratch.path(ids)])


def _sizes(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """``id``, ``size`` of the subtree, ``looped`` for nodes that lead into a cycle, ``on_loop`` for those on it.

    After round k a node knows its ancestor 2^k above, or that there is none, and the number of nodes
    fewer than 2^k levels below it. When no node with a root lies just 2^k - 1 links deep, whatever
    still has a pointer has no root.
    """
    st = nodes.select("id", F.col("pid").alias("jump"), F.when(F.col("pid").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("size"))
    seen = {"open": F.count("jump"), "deepest": F.max(F.when(F.col("jump").isNull(), F.col("dist")))}
    st = scratch.save(st, **seen)
    reach = 1
    while True:
        n_open, deepest = scratch.metric(st, "open"), scratch.metric(st, "deepest")
        if n_open == 0 or deepest is None or deepest < reach - 1:
            break
        up = st.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("dist").alias("_dist"))
        below = st.where("jump is not null").groupBy("jump").agg(F.sum("size").alias("_more")).withColumnRenamed("jump", "_under")
        open_ = st.where("jump is not null").join(up, F.col("jump") == F.col("_id")).select("id", F.col("_jump").alias("jump"), (F.col("dist") + F.col("_dist")).alias("dist"), "size")
        nxt = st.where("jump is null").select("id", "jump", "dist", "size").unionByName(open_)
        nxt = nxt.join(below, F.col("id") == F.col("_under"), "left").select("id", "jump", "dist", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))
        st = scratch.save(nxt, [scratch.path(st)], **seen)
        reach *= 2
    looped = F.col("jump").isNotNull().alias("looped")
    if n_open == 0:
        return st.select("id", "size", looped, F.lit(False).alias("on_loop"))
    on = _on_loops(scratch, st.where("jump is not null").select("id", "jump")).withColumnRenamed("id", "_on")
    return st.join(on, F.col("id") == F.col("_on"), "left").select("id", "size", looped, F.col("_on").isNotNull().alias("on_loop"))


def _on_loops(scratch: Scratch, pointers: DataFrame) -> DataFrame:
    """``id`` of the nodes on cycles, given those that lead into one with a pointer some links ahead.

    What is pointed at shrinks towards the cycles as the pointers double; once it no longer does, the
    pointers only permute it, so all of it lies on cycles.
    """
    met = scratch.save(pointers.select(F.col("jump").alias("id")).distinct(), n=F.count(F.lit(1)))
    while True:
        ahead = pointers.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"))
        pointers = scratch.save(pointers.join(ahead, F.col("jump") == F.col("_id")).select("id", F.col("_jump").alias("jump")))
        nxt = scratch.save(pointers.select(F.col("jump").alias("id")).distinct(), n=F.count(F.lit(1)))
        if scratch.metric(nxt, "n") == scratch.metric(met, "n"):
            return nxt
        met = nxt


def _light_offsets(kids: DataFrame) -> DataFrame:
    """For each light child: the sizes of its lighter siblings before it, summed in blocks."""
    blocked = kids.withColumn("_b", F.pmod(F.hash("id"), F.lit(SIBLING_BLOCKS)))
    sums = blocked.groupBy("pid", "_b").agg(F.sum("size").alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy("pid").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum("size").over(W.partitionBy("pid", "_b").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocked = blocked.withColumn("_own", own)
    s = sums.select(F.col("pid").alias("_p"), F.col("_b").alias("_sb"), "_before")
    return blocked.join(s, (F.col("pid") == F.col("_p")) & (F.col("_b") == F.col("_sb"))).select("id", (F.col("_own") + F.col("_before")).alias("elder"))


def hierarchy(spark: SparkSession, links: DataFrame, paths: bool = True) -> DataFrame:
    """Full hierarchies of ``links`` (``tree``, ``node``, ``parent``; other columns are ignored).

    Returns one row per node of a tree: ``tree``, ``node``, ``root``, ``depth``, ``n_descendants``,
    ``first_pos`` and ``last_pos`` (the node's own position and that of its last descendant in the
    tree of its root) and, with ``paths``, ``path`` (node names from the root down). A node with several
    parents takes the least; a parent that is null or not itself a node counts as none; rows with a
    null tree or node are left out; repeated rows count once. A node on a loop or below one has root
    '', depth -1 and null in the other columns; ``on_loop`` tells the two apart. An empty table gives no rows.
    """
    scratch = Scratch(spark)
    nodes = _numbered(scratch, links.select("tree", "node", "parent"))
    sized = nodes.join(_sizes(scratch, nodes).withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).drop("_i")
    sized = scratch.save(sized, [scratch.path(nodes)])
    sound = sized.where("not looped")

    # Heavy child of each parent; the least id of equally large ones.
    heavy = sound.where("pid is not null").groupBy("pid").agg(F.max(F.struct("size", (-F.col("id")).alias("n"))).alias("_h"))
    heavy = heavy.select(F.col("pid").alias("_hp"), (-F.col("_h.n")).alias("_heavy"), F.col("_h.size").alias("_hsize"))
    marked = sound.join(heavy, F.col("pid") == F.col("_hp"), "left").withColumn("light", F.coalesce(F.col("_heavy") != F.col("id"), F.lit(True)))
    marked = scratch.save(marked.select("tree", "node", "id", "pid", "size", "light", F.col("_hsize").alias("hsize")))

    seg = F.array("node") if paths else F.array().cast("array<string>")
    chain = marked.select("id", F.when(~F.col("light"), F.col("pid")).alias("jump"), F.when(F.col("light"), F.col("id")).alias("top"), (~F.col("light")).cast("long").alias("pos"), seg.alias("seg"))
    chain = _double(scratch, scratch.save(chain, open=F.count("jump")), {"pos": "sum", "seg": "concat"})

    # The chain tree: a chain hangs under the node above its head.
    lights = marked.where("light and pid is not null")
    heads = marked.where("light").select("id", "pid", F.coalesce("hsize", F.lit(0)).alias("hsize"))
    heads = heads.join(_light_offsets(lights.select("id", "pid", "size")).withColumnRenamed("id", "_oi"), F.col("id") == F.col("_oi"), "left").drop("_oi")
    at = chain.select(F.col("id").alias("_ci"), F.col("top").alias("_ctop"), F.col("pos").alias("_cpos"), F.col("seg").alias("_cseg"))
    up = heads.join(at, F.col("pid") == F.col("_ci"), "left").select(
        "id", F.col("_ctop").alias("jump"), F.when(F.col("pid").isNull(), F.col("id")).alias("top"),
        F.coalesce(F.col("_cpos") + 1, F.lit(0)).alias("depth"),
        F.coalesce(F.col("_cpos") + 1 + F.col("hsize") + F.col("elder"), F.lit(0)).alias("first"),
        F.coalesce("_cseg", F.array().cast("array<string>")).alias("above"),
    )
    up = _double(scratch, scratch.save(up, open=F.count("jump")), {"depth": "sum", "first": "sum", "above": "concat"})

    names = marked.where("light and pid is null").select(F.col("id").alias("_ri"), F.col("node").alias("root"))
    up = up.join(names, F.col("top") == F.col("_ri")).select(F.col("id").alias("_head"), "root", F.col("depth").alias("_d"), F.col("first").alias("_f"), "above")
    placed = marked.join(chain.select(F.col("id").alias("_ci"), "top", "pos", "seg"), F.col("id") == F.col("_ci")).join(up, F.col("top") == F.col("_head"))
    good = placed.select(
        "tree", "node", "root", (F.col("_d") + F.col("pos")).cast("int").alias("depth"), (F.col("size") - 1).alias("n_descendants"),
        (F.col("_f") + F.col("pos")).alias("first_pos"), (F.col("_f") + F.col("pos") + F.col("size") - 1).alias("last_pos"),
        F.concat("above", "seg").alias("path"), F.lit(False).alias("on_loop"),
    )
    none = F.lit(None).cast("long")
    bad = sized.where("looped").select("tree", "node", F.lit("").alias("root"), F.lit(-1).alias("depth"), none.alias("n_descendants"), none.alias("first_pos"), none.alias("last_pos"), F.lit(None).cast("array<string>").alias("path"), "on_loop")
    out = good.unionByName(bad)
    return out if paths else out.drop("path")


def descendants(placed: DataFrame, of: DataFrame) -> DataFrame:
    """All descendants of the nodes ``of`` (``tree``, ``node``): each one's chain interval, read off the order.

    ``placed`` is the result of :func:`hierarchy`. Returns ``tree``, ``node``, ``descendant``, ``steps``.
    A node that is unknown or leads into a loop has none. Nodes and intervals meet by block of the order,
    so a large tree is not paired whole: an interval looks at no more than a block at either end in vain.
    """
    a = placed.join(of.select(F.col("tree").alias("_t"), F.col("node").alias("_n")).distinct(), (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n")), "left_semi")
    a = a.where("depth >= 0 and last_pos > first_pos").select(F.col("tree").alias("_at"), F.col("root").alias("_ar"), F.col("node").alias("_an"), F.col("depth").alias("_ad"), F.col("first_pos").alias("_f"), F.col("last_pos").alias("_l"))
    block = lambda pos: F.floor(pos / F.lit(POSITION_BLOCK))
    a = a.withColumn("_ab", F.explode(F.sequence(block(F.col("_f") + 1), block(F.col("_l")))))
    p = placed.where("depth > 0").withColumn("_pb", block(F.col("first_pos")))
    cond = (F.col("tree") == F.col("_at")) & (F.col("root") == F.col("_ar")) & (F.col("_pb") == F.col("_ab")) & (F.col("first_pos") > F.col("_f")) & (F.col("first_pos") <= F.col("_l"))
    return p.join(a, cond).select("tree", F.col("_an").alias("node"), F.col("node").alias("descendant"), (F.col("depth") - F.col("_ad")).alias("steps"))
