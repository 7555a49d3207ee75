"""Parent-child rows to full hierarchies: paths, depth, roots, descendants and circles.

1. Peel leaves by doubling: after round k every remaining node has an ancestor 2**k steps up, so each round peels
   2**k layers. What no round can peel lies on a circle or leads into one; the circle itself is the image of the
   remaining nodes under the same doubled steps.
2. Every tree becomes an Euler tour, a linked list of one entry and one exit per node. Parallel list ranking by
   pointer jumping gives each element its place and the sum of +1/-1 up to it: entry-exit intervals and depths.

Every step is an equi join or an aggregate on node numbers; nothing is gathered per parent or per tree. A parent
with very many children is ordered in blocks of node numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.functions.temporal import reference_key
from ledgerloom.runtime import Scratch

#: Node numbers per block when siblings are put in order.
SIBLING_BLOCK = 50_000
#: Rounds of list ranking after which finished lists are taken out.
PRUNE_EVERY = 3
#: Rows per numbering bucket.
NUMBER_BLOCK = 100_000


def _numbered(nodes: DataFrame, n: int) -> DataFrame:
    """Dense numbers 0..n-1 in a stable order, without one global window."""
    buckets = max(1, -(-n // NUMBER_BLOCK))
    b = nodes.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sizes = b.groupBy("b").agg(F.count("*").alias("m"))
    # as many rows as buckets, one for each NUMBER_BLOCK nodes
    starts = sizes.withColumn("at", F.coalesce(F.sum("m").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("b", "at")
    b = b.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy("id")).cast("long"))
    return b.join(starts, "b").select((F.col("at") + F.col("r") - 1).alias("v"), "id", "pid")


def hierarchy(df: DataFrame, id_col: str, parent_col: str, scratch: Scratch | None = None) -> DataFrame:
    """One row per id: id, parent_id, root_id, depth, entry, exit, n_descendants.

    * Parents compare after trimming and lower-casing. A null, blank or unknown parent makes a root of depth 0.
    * Repeated rows of one id count once (the smallest parent wins where they disagree). Null ids are left out.
    * A node on a circle has depth -1, one leading into a circle -2; root_id is then the smallest id on the circle
      and entry, exit and n_descendants are null. An id that is its own parent is a circle of one.
    * entry and exit count 0.. within one tree; u is an ancestor of v when the two share root_id and u.entry <
      v.entry and v.exit < u.exit.
    * Columns other than the two named are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    rows = df.select(F.col(id_col).cast("string").alias("id"), reference_key(F.col(parent_col).cast("string")).alias("pid")).where(F.col("id").isNotNull())
    nodes = rows.groupBy("id").agg(F.min("pid").alias("pid"))
    named = scratch.save(nodes, count={"n": F.lit(True)})
    n = scratch.counted(named, "n")
    numbered = scratch.save(_numbered(named, n))
    scratch.drop(named)
    keys = numbered.select(F.lower("id").alias("k"), F.col("v").alias("p")).groupBy("k").agg(F.min("p").alias("p"))
    has = numbered.where(F.col("pid").isNotNull()).join(keys, F.col("pid") == F.col("k")).select("v", "p")
    edges = scratch.save(has, count={"n": F.lit(True)})
    circle = _circles(edges, numbered, scratch)
    tour = _tour(numbered, edges, circle, scratch)
    names = numbered.select("v", "id", "pid")
    roots = numbered.select(F.col("v").alias("root"), F.col("id").alias("root_id"))
    trees = (
        tour.join(names, "v")
        .join(roots, "root")
        .select("id", F.col("pid").alias("parent_id"), "root_id", "depth", "entry", "exit", ((F.col("exit") - F.col("entry") - 1) / 2).cast("long").alias("n_descendants"))
    )
    none = F.lit(None).cast("long")
    loops = circle.join(names, "v").select("id", F.col("pid").alias("parent_id"), "root_id", "depth", none.alias("entry"), none.alias("exit"), none.alias("n_descendants"))
    return trees.unionByName(loops)


def _circles(edges: DataFrame, numbered: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root_id, depth): the nodes that no peeling reaches."""
    # peel: keep the nodes that still have an ancestor 2**k up
    up, size = edges.select("v", F.col("p").alias("a")), None
    kept, m = up, scratch.counted(edges, "n")
    while m not in (0, size):
        size = m
        step = kept.select(F.col("v").alias("a"), F.col("a").alias("a2"))
        new = scratch.save(kept.join(step, "a").select("v", F.col("a2").alias("a")), count={"n": F.lit(True)})
        scratch.drop(*([kept] if kept is not up else []))
        kept, m = new, scratch.counted(new, "n")
    if size is None or m == 0:
        return kept.select("v", F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("long").alias("depth")).where("false")
    # kept: on a circle or leading into one. Double on until the image stops shrinking; that image is the circles.
    image = None
    while True:
        c = kept.select("a").distinct().count()
        if c == image:
            break
        image = c
        step = kept.select(F.col("v").alias("a"), F.col("a").alias("a2"))
        new = scratch.save(kept.join(step, "a").select("v", F.col("a2").alias("a")))
        scratch.drop(kept)
        kept = new
    core = kept.select(F.col("a").alias("v")).distinct()
    ring = scratch.save(core.join(edges, "v").join(numbered.select("v", "id"), "v").select("v", F.col("p").alias("a"), F.col("id").alias("low")))
    while True:
        step = ring.select(F.col("v").alias("a"), F.col("a").alias("a2"), F.col("low").alias("low2"))
        new = scratch.save(ring.join(step, "a").select("v", F.col("a2").alias("a"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")), count={"moved": F.col("moved")})
        moved = scratch.counted(new, "moved")
        scratch.drop(ring)
        ring = new.select("v", "a", "low")
        ring._scratch_path = new._scratch_path
        if not moved:
            break
    low = ring.select(F.col("v").alias("a"), F.col("low").alias("root_id"))
    on = ring.select("v", F.lit(True).alias("on"))
    return scratch.save(
        kept.join(low, "a").join(on, "v", "left").select("v", "root_id", F.when(F.col("on"), -1).otherwise(-2).cast("long").alias("depth"))
    )


def _tour(numbered: DataFrame, edges: DataFrame, circle: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root, depth, entry, exit) of every node of a tree, by ranking the Euler tours."""
    nodes = numbered.select("v").join(edges, "v", "left").join(circle.select("v"), "v", "left_anti")
    kids = nodes.where("p is not null").withColumn("b", F.floor(F.col("v") / SIBLING_BLOCK))
    # next sibling: within a block of node numbers, then from block to block of the same parent
    blocks = kids.groupBy("p", "b").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    hop = blocks.withColumn("hop", F.lead("first").over(W.partitionBy("p").orderBy("b"))).select("p", "b", "hop")
    sib = kids.withColumn("sib", F.lead("v").over(W.partitionBy("p", "b").orderBy("v"))).join(hop, ["p", "b"]).select("v", F.coalesce("sib", "hop").alias("sib"))
    first = kids.groupBy("p").agg(F.min("v").alias("kid")).withColumnRenamed("p", "v")
    full = nodes.join(first, "v", "left").join(sib, "v", "left")
    enter = lambda c: c * 2
    leave = lambda c: c * 2 + 1
    v = F.col("v")
    pair = F.array(
        F.struct(enter(v).alias("e"), F.coalesce(enter(F.col("kid")), leave(v)).alias("nxt"), F.lit(1).cast("long").alias("w")),
        F.struct(leave(v).alias("e"), F.coalesce(enter(F.col("sib")), leave(F.col("p"))).alias("nxt"), F.lit(-1).cast("long").alias("w")),
    )
    links = full.select(F.inline(pair), F.col("p").isNull().alias("top"))
    links = links.withColumn("head", F.col("top") & (F.col("e") % 2 == 0)).drop("top")
    start = scratch.save(links)
    ends = start.where("nxt is null").select("e")  # the exits of roots
    # (e, nxt, d, w): d elements and weight w from e up to, not including, nxt; done when nxt is the last of its list
    live = start.where("nxt is not null").join(ends.select(F.col("e").alias("nxt"), F.lit(True).alias("done")), "nxt", "left")
    open_ = {"open": ~F.col("done")}
    live = scratch.save(live.select("e", "nxt", F.lit(1).cast("long").alias("d"), "w", "head", F.coalesce("done", F.lit(False)).alias("done")), count=open_)
    finished: list[DataFrame] = [start.where("nxt is null").select("e", F.col("e").alias("last"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("w"))]
    rounds = 0
    while True:
        waiting = live.where("not done")
        if scratch.counted(live, "open") == 0:
            finished.append(live.select("e", F.col("nxt").alias("last"), "d", "w"))
            break
        step = live.select(F.col("e").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("d").alias("d2"), F.col("w").alias("w2"), F.col("done").alias("done2"))
        moved = waiting.join(step, "nxt").select("e", F.col("nxt2").alias("nxt"), (F.col("d") + F.col("d2")).alias("d"), (F.col("w") + F.col("w2")).alias("w"), "head", F.col("done2").alias("done"))
        new = scratch.save(live.where("done").unionByName(moved), count=open_)
        scratch.drop(live)
        rounds += 1
        if rounds % PRUNE_EVERY:
            live = new
            continue
        # lists whose head is done are ranked as a whole and leave the loop
        whole = new.where("head and done").select("nxt").distinct()
        done = new.where("done")
        out = scratch.save(done.join(whole, "nxt", "left_semi"))
        finished.append(out.select("e", F.col("nxt").alias("last"), "d", "w"))
        live = scratch.save(new.where("not done").unionByName(done.join(whole, "nxt", "left_anti")), count=open_)
        scratch.drop(new)
    ranked = finished[0]
    for f in finished[1:]:
        ranked = ranked.unionByName(f)
    # weight from e to the end of the list, its last element (-1) included, is minus the depth of what stands before e
    ranked = ranked.select(
        F.floor(F.col("e") / 2).alias("v"),
        F.floor((F.col("last") - 1) / 2).alias("root"),
        (F.col("e") % 2 == 0).alias("is_entry"),
        "d",
        "w",
    )
    both = ranked.groupBy("v", "root").agg(
        F.max(F.when(F.col("is_entry"), F.col("d"))).alias("d_in"),
        F.max(F.when(~F.col("is_entry"), F.col("d"))).alias("d_out"),
        F.max(F.when(F.col("is_entry"), F.col("w"))).alias("w_in"),
    )
    both = scratch.save(both.withColumn("depth", -(F.col("w_in") - 1)))
    top = both.where("v = root").select("root", F.col("d_in").alias("len"))
    return both.join(top, "root").select("v", "root", "depth", (F.col("len") - F.col("d_in")).alias("entry"), (F.col("len") - F.col("d_out")).alias("exit"))


#: Descendants of a node that are listed in one row's interval before it is cut.
INTERVAL = 100_000


def descendants(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(ancestor_id, descendant_id, distance) from the entry-exit intervals of `tree` (the result of hierarchy).

    Before a node's entry stand (entry + depth) / 2 entries, so the nodes of a tree are numbered in preorder and the
    descendants of a node are the numbers of one interval. Intervals are unrolled and meet the nodes in an equi join
    on (tree, number): as many rows as the result has, spread by number, however large a tree or a node's interval.
    With `of` (a table with column id) only the descendants of the asked nodes are listed.
    """
    sound = tree.where("depth >= 0").withColumn("no", ((F.col("entry") + F.col("depth")) / 2).cast("long"))
    a = sound if of is None else sound.join(of.select("id").distinct(), "id", "left_semi")
    a = a.where("n_descendants > 0").select(F.col("id").alias("ancestor_id"), "root_id", F.col("depth").alias("da"), (F.col("no") + 1).alias("lo"), (F.col("no") + F.col("n_descendants")).alias("hi"))
    long = F.col("hi") - F.col("lo") >= INTERVAL
    cut = a.where(long).withColumn("at", F.explode(F.sequence("lo", "hi", F.lit(INTERVAL).cast("long")))).repartition("root_id", "at")
    cut = cut.withColumn("hi", F.least("hi", F.col("at") + INTERVAL - 1)).withColumn("lo", F.col("at")).drop("at")
    every = a.where(~long).unionByName(cut).select("ancestor_id", "root_id", "da", F.explode(F.sequence("lo", "hi")).alias("no"))
    d = sound.select(F.col("id").alias("descendant_id"), "root_id", "no", "depth")
    return every.join(d, ["root_id", "no"]).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("da")).alias("distance"))


def paths(df: DataFrame, id_col: str, parent_col: str, scratch: Scratch | None = None, tree: DataFrame | None = None) -> DataFrame:
    """(id, root_id, depth, path): path is the array of ids from the root to the node, both included.

    The ancestors are those whose entry-exit intervals hold the node, the farthest first. Nodes on or leading into a
    circle have a null path. A path has to fit one row.
    """
    scratch = scratch or Scratch(df.sparkSession)
    tree = scratch.save(tree if tree is not None else hierarchy(df, id_col, parent_col, scratch))
    above = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("far"), "ancestor_id"))), lambda x: x["ancestor_id"])
    up = descendants(tree).groupBy(F.col("descendant_id").alias("id")).agg(above.alias("above"))
    path = F.when(F.col("depth") >= 0, F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("id")))
    return tree.join(up, "id", "left").select("id", "root_id", "depth", path.alias("path"))
