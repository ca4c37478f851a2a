"""Connected components over an edge table: joins and minima, no graph on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import materialize


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once, and neither its plan nor what the optimizer derived from it goes on."""
    return materialize(df, "components")


def _state(pairs: DataFrame) -> tuple:
    """Number and checksums of a set of edges, in one pass without a shuffle of its rows."""
    h = F.xxhash64("hi", "lo")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(1))), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1)))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternates star contraction: each node's larger neighbours are linked to its smallest neighbour, then
    each node's smaller neighbours are; the edge set never grows by more than its nodes and the depth halves,
    so rounds grow with the logarithm of the longest path. Each round is one grouped minimum and one
    join for either step, written to the shared folder (compressed, unlike a checkpoint). Null ends and self-loops are ignored;
    repeated edges count once; an empty table gives an empty result.
    """
    pairs = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
    )
    pairs = _kept(pairs.distinct())
    now = _state(pairs)
    for _ in range(max_rounds):
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .where(F.col("hi") != F.col("lo"))
            .distinct()
        )
        # Small star: neighbours below a node, and the node itself, go to the least of them.
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(below, "hi")
            .select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
            .where(F.col("hi") != F.col("lo"))
            .distinct()
        )
        after = _kept(small)
        # Done when every component is a star, which a round leaves as it is.
        before, now, pairs = now, _state(after), after
        if before == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    up = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return up.union(roots)


def _settled(labels: DataFrame, arcs: DataFrame, max_rounds: int) -> DataFrame:
    """(node, label): the least label of the nodes from which arcs (a to b) lead to each node, itself included. A label names a node, whose own label is taken
    over, too; labels are in no order that the graph knows of, so few nodes on a path are less than all before them and rounds are few."""
    before = None
    for _ in range(max_rounds):
        for _ in range(2):
            come = arcs.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
            labels = labels.unionByName(come).groupBy("node").agg(F.min("label").alias("label"))
        of = labels.select(F.col("node").alias("named"), F.col("label").alias("further"))
        labels = _kept(labels.join(of, F.col("label.node") == F.col("named"), "left").select("node", F.least("label", "further").alias("label")))
        now = _state(labels.select(F.col("node").alias("hi"), F.col("label.node").alias("lo")))
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def _ends(arcs: DataFrame) -> DataFrame:
    """(node, comes, goes): how many arcs lead to and from each node, and one of their other ends each."""
    ends = arcs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next"), F.lit(None).alias("prev")), F.struct(F.col("b").alias("node"), F.lit(None).alias("next"), F.col("a").alias("prev")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.count("prev").alias("comes"), F.count("next").alias("goes"), F.min("prev").alias("prev"), F.min("next").alias("next"))


def _peeled(arcs: DataFrame) -> DataFrame:
    """Without the arcs of nodes that no arc leads to, or from."""
    inner = _ends(arcs).where("comes > 0 AND goes > 0")
    for c in ("a", "b"):
        arcs = arcs.join(inner.select(F.col("node").alias(c)), c, "left_semi")
    return arcs.select("a", "b")


def _contracted(arcs: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Arcs with every run of nodes that one arc leads to and one from made a single arc; those nodes with the ends of their run (node, head, tail); and the
    nodes of rings, which have no end, with the least of their ring (node, component); no tables where there are no such nodes. Each round doubles how far
    along its run a node looks."""
    links = _ends(arcs).where("comes = 1 AND goes = 1").select("node", "prev", "next")
    on = lambda c: links.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_linked"))
    links = _kept(links.join(on("prev"), "prev", "left").join(on("next"), "next", "left"))
    n = links.count()
    if not n:
        return arcs, None, None
    last = links.select("node", F.when(F.col("next_linked"), F.col("next")).otherwise(F.col("node")).alias("at"), F.least("node", F.when(F.col("next_linked"), F.col("next")).otherwise(F.col("node"))).alias("least"))
    for _ in range(n.bit_length()):
        of = last.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("least").alias("less"))
        ahead = _kept(last.join(of, "at").select("node", F.col("further").alias("at"), F.least("least", "less").alias("least"), (F.col("further") != F.col("at")).alias("moved")))
        last = ahead.select("node", "at", "least")
        if not ahead.where("moved").limit(1).count():
            break
    runs = last.join(links.select(F.col("node").alias("at"), F.col("next").alias("tail"), "next_linked"), "at")
    rings = _kept(runs.where("next_linked").select("node", F.col("least").alias("component")))
    ended = runs.where("next_linked IS NULL").select("node", "at", "tail")
    heads = ended.join(links.where("prev_linked IS NULL").select("node", F.col("prev").alias("head")), "node").select("at", "head")
    runs = _kept(ended.join(heads, "at").select("node", "head", "tail"))
    kept = arcs.join(links.select(F.col("node").alias("a")), "a", "left_anti").join(links.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
    return _kept(kept.unionByName(runs.where("head <> tail").select(F.col("head").alias("a"), F.col("tail").alias("b"))).distinct()), runs, rings


def _put_back(found: DataFrame, runs: DataFrame) -> DataFrame:
    """(node, component) with the nodes of runs that begin and end in one component, or at one node."""
    end = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    whole = runs.join(end("head"), "head", "left").join(end("tail"), "tail", "left").where("head = tail OR head_of = tail_of")
    of = F.coalesce("head_of", "head")
    fresh = whole.where("head_of IS NULL").select(F.col("head").alias("node"), F.col("head").alias("component"))
    return _kept(found.unionByName(whole.select("node", of.alias("component"))).unionByName(fresh.distinct()))


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """(node, component): for every node on a cycle the least node of its strongly connected component.

    Arcs that lie on no cycle are peeled off from both ends, and runs of nodes without branches become one arc each, so that a path of any length goes in
    rounds that grow with its logarithm. Of the rest, each node takes the least (by a hash) of the nodes that reach it; inside of such a class, those from which
    that least node is reached make up its component and leave, and the others go on, without the arcs between classes. Then the runs that begin and end in one
    component join it. Null ends and self-loops are ignored; a graph without cycles gives an empty result.
    """
    live = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.col(src).alias("a"), F.col(dst).alias("b"))
    live = _kept(live.distinct())
    n, found, runs = live.count(), [], []
    for _ in range(max_rounds):
        before = -1
        while n != before and n:
            before = n
            live, run, rings = _contracted(_kept(_peeled(live)))
            if run is not None:
                runs.append(run)
                found.append(rings)
            n = live.count()
        if not n:
            break
        own = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.struct(F.xxhash64("node").alias("h"), "node"))
        classes = _settled(own, live, max_rounds)
        of = lambda c: classes.select(F.col("node").alias(c), F.col("label").alias(f"{c}_class"))  # noqa: B023, E731
        inside = _kept(live.join(of("a"), "a").join(of("b"), "b").where("a_class = b_class").select("a", "b"))
        back = _settled(own, inside.select(F.col("b").alias("a"), F.col("a").alias("b")), max_rounds).withColumnRenamed("label", "reached")
        done = _kept(classes.join(back, "node").where("label = reached").select("node", F.col("label.node").alias("component")))
        found.append(done)
        gone = lambda c: done.select(F.col("node").alias(c))  # noqa: B023, E731
        live = _kept(inside.join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti").select("a", "b"))
        n = live.count()
    if not found:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    every = _kept(reduce(DataFrame.unionByName, found))
    sizes = every.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    every = _kept(every.join(sizes.select("component"), "component", "left_semi").select("node", "component"))
    for run in reversed(runs):
        every = _put_back(every, run)
    least = every.groupBy("component").agg(F.min("node").alias("least"))
    return every.join(least, "component").select("node", F.col("least").alias("component"))
