"""Graph analytics: layering, longest chain, reachability, roles. Loops run on the driver, one join a step, over
staged tables; only whether a step found anything comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import PARTS, Rounds, cut, drop
from .graph import CHINESE


def backbone(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def _apart(df: DataFrame) -> DataFrame:
    """df for a join's other side: both are dealt by the key. Files of names are small beside the rows in them, so Spark would broadcast more and more."""
    return df.hint("shuffle_merge")


#: Edges that a task of a round holds. Every task of every round tells the driver its figures, so tasks grow with the edges only.
EDGES = 1_000_000


def _dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df held by the executors and dealt to n tasks by a key: a round that joins it by the key moves only its own rows, and none through the driver."""
    return df.repartition(n, key).persist()


def _released(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth, done): the longest path from a node that nothing enters, over nodes released so far; done is false where a
    cycle holds a node back. An edge counts as its `weight`, or as 1.

    A round releases the nodes whose last edge is hit. It touches only what the round before hits and what has been hit in part:
    neither released nor untouched nodes move.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    known = cut(nodes.select("node").distinct())
    e = cut(edges.groupBy("src", "dst").agg(F.max(weight).alias("weight")).join(_apart(known.select(F.col("node").alias("src"))), "src", "left_semi").join(_apart(known.select(F.col("node").alias("dst"))), "dst", "left_semi"))
    n = e.count() // EDGES + 1
    entering = _dealt(cut(e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("open"))), "node", n)
    e = _dealt(e, "src", n)
    rounds = Rounds(e.sparkSession, "round", n)
    none = F.lit(0).cast("bigint")
    now = rounds.add(known.join(_apart(entering), "node", "left_anti").select("node", none.alias("hit"), none.alias("open"), F.lit(0).alias("last")))
    while not now.where("hit = open").isEmpty():
        ready = now.where("hit = open").select(F.col("node").alias("src"), "last")
        hits = e.join(ready.hint("shuffle_hash"), "src").select(F.col("dst").alias("node"), F.lit(1).cast("bigint").alias("hit"), (F.col("last") + F.col("weight")).cast("int").alias("last"))
        touched = hits.unionAll(now.where("hit < open").select("node", "hit", "last")).groupBy("node").agg(F.sum("hit").alias("hit"), F.max("last").alias("last"))
        now = rounds.add(entering.join(touched.hint("shuffle_hash"), "node").select("node", "hit", "open", "last"))
    e.unpersist()
    entering.unpersist()
    done = rounds.read().where("hit = open").select("node", F.col("last").alias("depth"), F.lit(True).alias("done"))
    held = known.join(_apart(done), "node", "left_anti").join(_apart(now), "node", "left").select("node", F.coalesce("last", F.lit(0)).alias("depth"), F.lit(False).alias("done"))
    return done.unionAll(held)


def _chains(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jumps, rings) of the nodes of edges (src, dst: distinct, no loops) that one edge leaves.

    jumps: tables (node, to, n, far, least), each leading twice as far as the one before, but not past a node that no edge or several leave; in
    the last one every node has come to such an end, or far is true: it leads to a ring of nodes with one edge each. rings: (node, component) of
    those, named by their least node.
    """
    one = edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to"), F.count(F.lit(1)).alias("k")).where("k = 1").select("node", "to")
    inner = one.select(F.col("node").alias("to"), F.lit(True).alias("more"))
    jumps = [cut(one.join(_apart(inner), "to", "left").select("node", "to", F.lit(1).alias("n"), F.coalesce("more", F.lit(False)).alias("far"), F.least("node", "to").alias("least")))]
    before, steps = -1, 1
    while True:
        rings = jumps[-1].where("far").agg(F.count_distinct("to")).first()[0]
        if rings == 0 or (rings == before and steps >= rings):  # twice as far leads to no fewer nodes: all of them lie on rings, and are seen whole
            break
        onward = jumps[-1].select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("n").alias("m"), F.col("far").alias("further"), F.col("least").alias("lower"))
        going = jumps[-1].where("far").join(onward.hint("shuffle_hash"), "to").select("node", F.col("beyond").alias("to"), (F.col("n") + F.col("m")).alias("n"), F.col("further").alias("far"), F.least("least", "lower").alias("least"))
        jumps.append(cut(going.unionAll(jumps[-1].where("not far"))))
        before, steps = rings, 2 * steps
    on = jumps[-1].where("far").select(F.col("to").alias("node")).distinct()
    return jumps, cut(jumps[-1].join(_apart(on), "node", "left_semi").select("node", F.col("least").alias("component")))


def _contracted(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """The edges of nodes that several leave, each led on to the end of the chain it enters; weight is the edges on the way. Edges into chains that
    end in a ring are left out. ends: the last table of _chains."""
    several = edges.join(_apart(ends.select(F.col("node").alias("src"))), "src", "left_anti")
    on = several.join(_apart(ends.select(F.col("node").alias("dst"), "to", "n", "far")), "dst", "left").where("far is null or not far")
    return on.groupBy("src", F.coalesce("to", "dst").alias("dst")).agg(F.max(F.coalesce("n", F.lit(0)) + 1).alias("weight"))


def layer_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): the longest path from a node that nothing enters, over nodes released so far. Nodes in or behind a
    cycle are never released and get 1 at least. Parallel edges count once; edges to unknown nodes don't."""
    return _released(nodes, edges).select("node", F.when(F.col("done"), F.col("depth")).otherwise(F.greatest(F.lit(1), "depth")).alias("depth"))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between these nodes."""
    return edges.join(_apart(nodes.select(F.col("node").alias("src"))), "src", "left_semi").join(_apart(nodes.select(F.col("node").alias("dst"))), "dst", "left_semi").select("src", "dst")


def _core(edges: DataFrame) -> DataFrame:
    """The edges between nodes that lie on a cycle or between two."""
    for turn in (False, True):
        given = _turned(edges) if turn else edges
        edges = cut(_inside(edges, _released(backbone(edges), given).where("not done")))
        if edges.isEmpty():
            break
    return edges


def _cycles(core: DataFrame) -> DataFrame:
    """(node, root) of some strongly connected components of core, one at least. Every node takes the largest colour among those that lead to
    it, colours being hashes of nodes; what leads back to the node a colour is from, within the colour, is a component."""
    own = backbone(core).select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("root")).alias("colour"))
    colours = changed = cut(own)
    while not changed.isEmpty():
        offered = core.join(changed, core["src"] == changed["node"]).groupBy("dst").agg(F.max("colour").alias("offer"))
        step = cut(colours.join(offered, colours["node"] == offered["dst"], "left").select("node", F.greatest("colour", F.coalesce("offer", "colour")).alias("colour"), F.coalesce(F.col("offer") > F.col("colour"), F.lit(False)).alias("new")))
        drop(colours)
        colours, changed = step.select("node", "colour"), step.where("new").select("node", "colour")
    ends = lambda end: colours.select(F.col("node").alias(end), F.col("colour.root").alias("root"))
    alike = cut(core.join(ends("src"), "src").join(ends("dst"), ["dst", "root"]).select("src", "dst", "root"))
    rounds = Rounds(core.sparkSession, "round")
    near = rounds.add(colours.where("node = colour.root").select("node", F.col("colour.root").alias("root")))
    while not near.isEmpty():
        before = alike.join(near.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "root").distinct()
        near = rounds.add(before.join(rounds.read().select("node"), "node", "left_anti"))
    return rounds.read().select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (src, dst): the strongly connected component, named by its least node.

    Nodes that one edge leaves are followed by pointer doubling: rings of them are components, and a chain of them stands for an edge to its end.
    Then forward-backward colouring: what no cycle holds is peeled off from both sides; in the rest each round of colours settles
    the component of every node that is the largest of all that lead to it, and the rest is peeled again. At last a node of a chain is in the
    component of its end if that leads to it.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    jumps, rings = _chains(e)
    short = cut(_contracted(e, jumps[-1]).select("src", "dst"))
    found, core = None, _core(cut(short.where("src <> dst")))
    while not core.isEmpty():
        some = cut(_cycles(core))
        found = some if found is None else found.unionAll(some)
        ends = lambda end: some.select(F.col("node").alias(end))  # noqa: B023, E731
        core = _core(cut(core.join(ends("src"), "src", "left_anti").join(ends("dst"), "dst", "left_anti").select("src", "dst")))
    loops = short.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root"))
    found = cut(loops if found is None else found.unionAll(loops.join(found, "node", "left_anti")))
    # a chain's node is reached from its end's component where an edge of that enters the chain, or where a reached node's chain goes on
    last = jumps[-1].where("not far").join(_apart(found.select(F.col("node").alias("to"), "root")), "to")
    reached = cut(e.join(last.select(F.col("node").alias("dst"), "root"), "dst").join(found.select(F.col("node").alias("src"), "root"), ["src", "root"]).select(F.col("dst").alias("node"), "root").distinct())
    if not reached.isEmpty():
        for jump in jumps:
            reached = cut(reached.unionAll(reached.join(jump.where("far").select("node", "to"), "node").select(F.col("to").alias("node"), "root")).distinct())
        found = found.unionAll(reached)
    names = found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component").unionAll(rings)
    return backbone(e).union(backbone(edges)).distinct().join(_apart(names), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _condensed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """edges with component names for ends, those within a component too."""
    ends = lambda end: _apart(parts.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(ends("src"), "src").join(ends("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)


def _longest(edges: DataFrame) -> DataFrame | None:
    """(node, height) over edges (src, dst), distinct; None where there is a cycle. Chains of nodes that one edge leaves count as one edge."""
    jumps, rings = _chains(edges)
    if not rings.isEmpty():
        return None
    ends = jumps[-1]
    short = cut(_contracted(edges, ends))
    rest = cut(backbone(edges).join(_apart(ends), "node", "left_anti"))
    found = _released(rest, short.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    if not found.where("not done").isEmpty():
        return None
    found = cut(found.select("node", (F.col("depth") + 1).alias("height")))
    return found.unionAll(ends.join(_apart(found.withColumnRenamed("node", "to")), "to").select("node", (F.col("height") + F.col("n")).alias("height")))


def _heights(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((node, height), components): heights of nodes where there is no cycle, else of components."""
    e = cut(edges.select("src", "dst").distinct())
    found = None if not e.where("src = dst").isEmpty() else _longest(e)
    if found is not None:
        return found, None
    parts = cut(components(e))
    between = cut(_condensed(e, parts).where("src <> dst").distinct())
    above = _longest(between)
    alone = parts.select(F.col("component").alias("node")).distinct().join(_apart(backbone(between)), "node", "left_anti")
    return above.unionAll(alone.select("node", F.lit(1).alias("height"))), parts


def heights(edges: DataFrame) -> DataFrame:
    """(node, height): nodes on the longest path that starts there. A cycle counts as one node, and its nodes have one height."""
    h, parts = _heights(edges)
    return h if parts is None else parts.join(_apart(h.withColumnRenamed("node", "component")), "component").select("node", "height")


def main_chain(edges: DataFrame) -> DataFrame:
    """(position, node) of a longest path. Of starts and successors of equal height the one whose edge comes first (by
    ord) stays. edges: src, dst, ord. A cycle is one step of the path, named by its least node. The chain doubles at each step: its nodes so far
    and the jump over as many successors give the next ones."""
    h, parts = _heights(edges)
    h, every = cut(h), edges if parts is None else _condensed(edges, parts)
    e = every.where("src <> dst")
    first = F.min_by("dst", F.struct(-F.col("height"), "ord"))
    jump = cut(e.join(_apart(h.withColumnRenamed("node", "dst")), "dst").groupBy("src").agg(first.alias("next")))
    order = every.groupBy(F.col("src").alias("node")).agg(F.min("ord").alias("ord"))
    start = h.join(_apart(e.select(F.col("dst").alias("node"))), "node", "left_anti").join(_apart(order), "node").orderBy(F.col("height").desc(), "ord").limit(1)
    chain, size = cut(start.select(F.lit(0).alias("position"), "node")), 1
    while True:
        more = cut(chain.join(_apart(jump), chain["node"] == jump["src"]).select((F.col("position") + size).alias("position"), F.col("next").alias("node")))
        if more.isEmpty():
            return chain
        chain, size = chain.unionAll(more), 2 * size
        onward = jump.select(F.col("src").alias("next"), F.col("next").alias("far"))
        before, jump = jump, cut(jump.join(onward.hint("shuffle_hash"), "next").select("src", F.col("far").alias("next")))
        drop(before)


#: Bits of a number, and numbers that a row of reachable() carries: its starts are their bits.
WORD, WORDS = 64, 8
#: Nodes next to each other by name that are dealt together, and rounds whose rows are folded into one a node.
CELL, FOLD = 8192, 8


def _reached(edges: DataFrame, starts: DataFrame, ways: list[str]) -> DataFrame:
    """(way, start, node, distance). A row is a node and the set of the starts that have come to it, as the bits of WORDS
    numbers, so that rounds move nodes and not pairs; a round keeps only bits that are new, and its number is their distance.

    Nodes are numbers in the order of names, an even one v for the way forward and the odd one behind it for the way back. Executors hold the edges, dealt by
    cells of neighbours: a round deals the nodes that the last one found, and where edges stay near their cell, what they hit meets before it is dealt.
    """
    from .dedup import sequence_ids

    seq = F.col("seq")
    named = cut(sequence_ids(starts.select(F.col("node").alias("start")).distinct(), "", 1, ["start"], 0).select("start", "seq"))
    names = cut(sequence_ids(backbone(edges), "", 1, ["node"], 0).select("node", seq.alias("id")))
    number = lambda end: _apart(names.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id")))
    ids = cut(edges.select("src", "dst").join(number("src"), "src").join(number("dst"), "dst").select("src_id", "dst_id").distinct())
    both = {"forward": (0, "src_id", "dst_id"), "backward": (1, "dst_id", "src_id")}
    cell = (F.floor(F.col("v") / (2 * CELL)) * 2 + F.col("v") % 2).alias("cell")
    e = None
    for way in ways:
        odd, start, end = both[way]
        part = ids.select((F.col(start) * 2 + odd).alias("v"), (F.col(end) * 2 + odd).alias("to"))
        e = part if e is None else e.unionAll(part)
    n = ids.count() * len(ways) // EDGES + 1
    e = _dealt(e.select(cell, "v", "to"), "cell", n)
    key, zero, numbers = ["v", "block"], F.lit(0).cast("bigint"), range(WORDS)
    bits = [f"b{k}" for k in numbers]
    width = WORD * WORDS
    own = [F.when(F.floor(seq % width / WORD) == k, F.expr(f"shiftleft(1L, cast(seq % {WORD} as int))")).otherwise(zero).alias(f"b{k}") for k in numbers]
    frontier = named.join(_apart(names), named["start"] == names["node"]).select(F.explode(F.array(*[F.col("id") * 2 + both[w][0] for w in ways])).alias("v"), F.floor(seq / width).alias("block"), *own).select(cell, *key, *bits)
    rounds, old, folded = Rounds(edges.sparkSession, "round", n), None, 0
    while True:
        hits = e.join(frontier.hint("shuffle_hash"), ["cell", "v"]).select(F.col("to").alias("v"), "block", *[F.col(b).alias(f"h{b}") for b in bits], *[zero.alias(f"s{b}") for b in bits])
        if rounds.n:
            seen = rounds.read().where(F.col("round") >= folded).select(*key, *bits)
            seen = seen if old is None else seen.unionAll(old)
            if rounds.n - folded >= FOLD:
                before, old, folded = old, cut(seen.groupBy(*key).agg(*[F.bit_or(b).alias(b) for b in bits])), rounds.n
                seen = old
                if before is not None:
                    drop(before)
            hits = hits.unionAll(seen.select(*key, *[zero.alias(f"h{b}") for b in bits], *[F.col(b).alias(f"s{b}") for b in bits]))
        found = hits.groupBy(*key).agg(*[F.bit_or(f"{x}{b}").alias(f"{x}{b}") for x in "hs" for b in bits])
        new = found.select(cell, *key, *[F.col(f"h{b}").bitwiseAND(F.bitwise_not(f"s{b}")).alias(b) for b in bits])
        frontier = rounds.add(new.where(" or ".join(f"{b} <> 0" for b in bits)))
        if frontier.isEmpty():
            break
    e.unpersist()
    drop(ids)
    # dealt to a number of tasks, as few bytes here become many rows
    tasks = int(edges.sparkSession.conf.get(PARTS))
    rows = rounds.read().select(F.floor(F.col("v") / 2).alias("id"), F.when(F.col("v") % 2 == 0, "forward").otherwise("backward").alias("way"), "block", "round", *bits).repartition(tasks, "id").join(names.hint("shuffle_hash"), "id")
    words = rows.select("way", "node", "block", "round", F.posexplode(F.array(*bits)).alias("word", "bits")).where("bits <> 0")
    each = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)
    found = words.select("way", "node", (F.col("block") * width + F.col("word") * WORD).alias("least"), (F.col("round") + 1).alias("distance"), F.explode(each).alias("bit"))
    return found.select("way", "node", "distance", (F.col("least") + F.col("bit")).alias("seq")).join(named, "seq").select("way", "start", "node", "distance")


def reachable(edges: DataFrame, starts: DataFrame, backward: bool = False) -> DataFrame:
    """(start, node, distance) of all nodes that edges lead to; a start is among its own only on a cycle."""
    return _reached(edges, starts, ["backward" if backward else "forward"]).drop("way")


def reachable_both(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(direction, start, node, distance) along the edges and against them, in the same rounds."""
    return _reached(edges, starts, ["forward", "backward"]).withColumnRenamed("way", "direction")


def focus(edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """A node with all before and behind it, and the edges between them."""
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(node).alias("node"))
    ids = start.union(reachable_both(edges, start).select("node")).distinct().select(F.col("node").alias("id"))
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return ids, inside


def _beside(edges: DataFrame, types: list[str], main: DataFrame) -> DataFrame:
    """Nodes that an edge of these types joins to a main node, in either direction."""
    e = edges.where(F.col("type").isin(*types))
    m = main.select("node")
    return e.join(m, e["dst"] == m["node"]).select(F.col("src").alias("id")).union(e.join(m, e["src"] == m["node"]).select(F.col("dst").alias("id"))).distinct()


def roles(nodes: DataFrame, edges: DataFrame, main: DataFrame) -> DataFrame:
    """(id, role) by priority: example, entry or main, branch, extension, related, isolated. nodes: id, type; main: position, node."""
    flag = lambda df, name: _apart(df.select("id", F.lit(True).alias(name)))
    out = (nodes.select("id", "type").join(main.select(F.col("node").alias("id"), "position"), "id", "left")
           .join(flag(_beside(edges, ["PREREQUISITE"], main), "branch"), "id", "left").join(flag(_beside(edges, ["EXTENDS"], main), "extension"), "id", "left")
           .join(flag(_beside(edges, ["RELATED"], main), "related"), "id", "left"))
    return out.select("id", F.when(F.col("type") == "example", "example").when(F.col("position") == 0, "entry").when(F.col("position").isNotNull(), "main")
                      .when(F.col("branch"), "branch").when(F.col("extension"), "extension").when(F.col("related"), "related").otherwise("isolated").alias("role"))


def style_roles(nodes: DataFrame, edges: DataFrame, main: DataFrame) -> DataFrame:
    """The variant for styling: any EXTENDS or RELATED edge counts, and examples have no role of their own."""
    def touched(kind: str, name: str) -> DataFrame:
        e = edges.where(F.col("type") == kind)
        return e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct().select("id", F.lit(True).alias(name))

    out = nodes.select("id").join(main.select(F.col("node").alias("id"), "position"), "id", "left")
    for kind, name in (("PREREQUISITE", "branch"), ("EXTENDS", "extension"), ("RELATED", "related")):
        out = out.join(_apart(touched(kind, name)), "id", "left")
    return out.select("id", F.when(F.col("position") == 0, "entry").when(F.col("position").isNotNull(), "main").when(F.col("branch"), "branch")
                      .when(F.col("extension"), "extension").when(F.col("related"), "related").otherwise("isolated").alias("role"))


def nearest_main(nodes: DataFrame, edges: DataFrame, main: DataFrame) -> DataFrame:
    """(id, main_index): the least position of a main node beside it, 0 if there is none."""
    e = edges.where(F.col("type").isin("PREREQUISITE", "EXTENDS", "RELATED"))
    near = e.select(F.col("src").alias("id"), F.col("dst").alias("node")).unionAll(e.select(F.col("dst").alias("id"), F.col("src").alias("node")))
    least = near.join(main, "node").groupBy("id").agg(F.min("position").alias("p"))
    return nodes.select("id").join(_apart(least), "id", "left").select("id", F.coalesce("p", F.lit(0)).alias("main_index"))


def slots(placed: DataFrame, gap: float = 80.0) -> DataFrame:
    """placed (role, anchor, id) with each node's slot beside its anchor and its centred offset. Rows are numbered over ranges, so that no
    task sorts a whole anchor; an anchor's first number and size come from sums."""
    from .dedup import sequence_ids

    numbered = sequence_ids(placed, "", 1, ["role", "anchor", "id"]).drop("seq_id")
    first = numbered.groupBy("role", "anchor").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("n"))
    out = numbered.join(first, ["role", "anchor"]).withColumn("slot", (F.col("seq") - F.col("_first")).cast("int"))
    return out.select(*placed.columns, "slot", "n", (F.col("slot") * gap - (F.col("n") - 1) * gap / 2).alias("offset"))


def chain_edges(edges: DataFrame, main: DataFrame) -> DataFrame:
    """edges with kind main (between consecutive main nodes) or aux; of parallel edges of a pair the first is main."""
    step = main.select(F.col("node").alias("src"), "position").join(main.select(F.col("node").alias("dst"), (F.col("position") - 1).alias("position")), "position")
    first = edges.join(step, ["src", "dst"]).groupBy("src", "dst").agg(F.min("ord").alias("ord")).withColumn("is_main", F.lit(True))
    return edges.join(first, ["src", "dst", "ord"], "left").withColumn("kind", F.when(F.col("is_main"), "main").otherwise("aux")).drop("is_main")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("id").join(_apart(into), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("in_degree"))


def layered_positions(depths: DataFrame, labels: DataFrame, gap_x: float = 160.0, gap_y: float = 120.0) -> DataFrame:
    """(node, x, y): layers below each other, the nodes of a layer in the Chinese order of their labels, centred. (The reference orders by the mean of
    the parents' layer centres first, but a centred layer's centre is 0; its relaxation and nudges after that are left out.) Nodes
    are numbered over ranges, so that no task sorts a whole layer. depths: node, depth; labels: node, label."""
    from .dedup import sequence_ids

    named = depths.join(_apart(labels), "node", "left").select("node", "depth", F.collate(F.coalesce("label", F.lit("")), CHINESE).alias("label"))
    numbered = cut(sequence_ids(named, "", 1, ["depth", "label", "node"]).select("node", "depth", "seq"))
    layers = numbered.groupBy("depth").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    return numbered.join(layers, "depth").select("node", ((F.col("seq") - F.col("first")) * gap_x - (F.col("n") - 1) * gap_x / 2).alias("x"), (F.col("depth") * gap_y).alias("y"))
