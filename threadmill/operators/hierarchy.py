"""Parent-child rows as full hierarchies: root, depth, path and descendants of every node, and cycles.

Fragments are bounded blocks of a tree's rows (session and a block of line numbers). Within a fragment each node's
chain of parents is contracted to the fragment exit (`contract`). The exits form a quotient forest, which is far
smaller, and which is solved in the same way (`_solve` calls itself); where it hardly shrinks, by pointer doubling.
Its results are expanded to the fragments (`_expand`), and sums over subtrees flow from quotient to fragments too.
A chain that closes within a fragment is a local cycle, one that closes in a quotient a global one.

`every_path` gives the full path of every node as rows, `descendants` all descendants of every node: chains within small
fragments are written out whole (`_ways`), and what lies above a fragment is joined to its nodes. `paths` gives the full
paths of stated nodes: their fragments' chains, and those that the quotient's path enters, are expanded. These rows take
quadratic space where trees are deep, so `hierarchy` also has short lossless forms: a node holds the part of its path back
to an anchor at most ANCHOR steps above (`path_tail`) and the anchor; and a node has its place in preorder (`first`) and
the number of its descendants, so that the descendants of a node are the nodes of its root from first + 1 to
first + n_descendants, and its path the nodes whose range holds it.

Defined results: a null or blank parent marks a root; a parent that is not there makes its child the top of a broken
tree (status 'missing'); of several rows with one id the one at the highest position counts (of equal positions the
greatest parent id); rows without id are left out; nodes in or below a cycle have status 'cycle' and no root or depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import norm_id
from ..functions.fragments import map_fragments
from ..plans import blocked
from ..session import cut_lineage

#: Width of a block of positions, nodes of a quotient that one task solves, steps between anchors of paths, width of a block whose paths are written out.
BLOCK, SMALL, ANCHOR, PIECE = 4096, 65_536, 16, 512

LOCAL = "tree string, frag long, id string, pos long, up string, len long, w long, top string, dist long, exit_up string, exit_len long, root string, depth long, status string, lsum long, anchor string, tail array<string>"


def tree_nodes(df: DataFrame, tree: str = "session_id", node: str = "uuid", parent: str = "parent_uuid", pos: str = "line_no") -> DataFrame:
    """tree, id, up, pos: one row per node with ids in their comparable form."""
    d = df.select(norm_id(tree).alias("tree"), norm_id(node).alias("id"), norm_id(parent).alias("up"), F.col(pos).cast("long").alias("pos"))
    return (
        d.filter("id is not null").groupBy("tree", "id")
        .agg(F.max(F.struct("pos", "up")).alias("x")).select("tree", "id", "x.up", "x.pos")
    )


def contract(group: dict, with_sums: bool, with_paths: bool) -> dict:
    """Contracts the parent chains of one fragment.

    For each node: its local top, its distance to it, and what lies beyond: exit_up, a parent outside; or root, depth
    and status, where the chain ends here. lsum, at tops only: the sum of w over the local tree.
    """
    ids, ups, lens, weights = group["id"], group["up"], group["len"], group["w"]
    n = len(ids)
    at = dict(zip(ids, range(n)))
    parent = [at.get(u, -1) if u is not None else -1 for u in ups]
    top, dist, hops, order = [-1] * n, [0] * n, [0] * n, []
    for start in range(n):
        if top[start] != -1:
            continue
        chain, i = [], start
        while i != -1 and top[i] == -1:
            top[i] = -3  # on this chain
            chain.append(i)
            i = parent[i]
        if i == -1:
            i = chain.pop()
            top[i] = i
            order.append(i)
            t = i
        else:
            t = -2 if top[i] in (-2, -3) else top[i]
        for c in reversed(chain):
            top[c] = t
            if t >= 0:
                dist[c], hops[c] = dist[parent[c]] + lens[c], hops[parent[c]] + 1
                order.append(c)
    sums = list(weights) if with_sums else [None] * n
    if with_sums:
        for c in reversed(order):
            if parent[c] >= 0:
                sums[parent[c]] += sums[c]
    out = {"tree": group["tree"], "frag": group["frag"], "id": ids, "pos": group["pos"], "up": ups, "len": lens, "w": weights, "dist": dist}
    tops, exits, exit_len, roots, depths, states, lsum = [], [], [], [], [], [], []
    for i in range(n):
        t = top[i]
        if t < 0:
            tops.append(None), exits.append(None), exit_len.append(0), roots.append(None), depths.append(None), states.append("cycle")
        elif ups[t] is None:  # resolved here
            tops.append(ids[t]), exits.append(None), exit_len.append(0), states.append(group["status"][t])
            roots.append(group["root"][t])
            depths.append(None if group["depth"][t] is None else group["depth"][t] + dist[i])
        else:
            tops.append(ids[t]), exits.append(ups[t]), exit_len.append(lens[t]), roots.append(None), depths.append(None), states.append(None)
        lsum.append(sums[i] if t == i else None)
    anchors, tails = [None] * n, [None] * n
    if with_paths:
        for i in order:
            if parent[i] < 0 or hops[i] % ANCHOR == 0:
                anchors[i], tails[i] = ups[i], [ids[i]]
            else:
                anchors[i], tails[i] = anchors[parent[i]], tails[parent[i]] + [ids[i]]
    return out | {"top": tops, "exit_up": exits, "exit_len": exit_len, "root": roots, "depth": depths, "status": states, "lsum": lsum, "anchor": anchors, "tail": tails}


def accumulate(group: dict) -> dict:
    """Sums over the subtrees of one fragment, with what other fragments add at their attachment points (extra)."""
    ids, ups = group["id"], group["up"]
    at = dict(zip(ids, range(len(ids))))
    total = [w + (e or 0) for w, e in zip(group["w"], group["extra"])]
    for i in sorted((i for i in range(len(ids)) if group["top"][i] is not None), key=lambda i: -group["dist"][i]):
        p = at.get(ups[i], -1) if ups[i] is not None else -1
        if p >= 0:
            total[p] += total[i]
    return {"tree": group["tree"], "id": ids, "total": [t if x is not None else None for t, x in zip(total, group["top"])]}


def _doubling(q: DataFrame) -> DataFrame:
    """Root, depth and status of a quotient by pointer doubling: for forests that contraction hardly shrinks."""
    n, round_ = q.count(), 0
    cur = cut_lineage(q.select("tree", "id", "up", "len", "root", "depth", "status"))
    while round_ <= n.bit_length() + 1 and cur.filter("up is not null").limit(1).count():
        p = cur.select("tree", F.col("id").alias("up"), F.col("up").alias("p_up"), F.col("len").alias("p_len"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), F.col("status").alias("p_status"))
        is_open = F.col("up").isNotNull()
        step = lambda mine, theirs: F.when(is_open, theirs).otherwise(F.col(mine)).alias(mine)
        cur = cut_lineage(cur.join(p, ["tree", "up"], "left").select(
            "tree", "id", step("up", F.col("p_up")), step("len", F.col("len") + F.col("p_len")),
            step("root", F.col("p_root")), step("depth", F.col("p_depth") + F.col("len")), step("status", F.col("p_status")),
        ))
        round_ += 1
    return cur.select("tree", "id", "root", "depth", F.when(F.col("up").isNotNull(), "cycle").otherwise(F.col("status")).alias("status"))


def _ranked(core: DataFrame, width: int) -> tuple[DataFrame, Column]:
    """A quotient in blocks of width nodes each, whatever their positions: the rows, and the block."""
    ranked = blocked.running_sum(core, ["tree"], "pos", F.lit(1), "rank")
    return ranked, F.floor((F.col("rank") - 1) / width).cast("long")


def _solve(nodes: DataFrame, block: Column, n_nodes: int | None, block_width: int, sums: bool, paths: bool, small: int) -> DataFrame:
    """nodes: tree, id, pos, up, len, w, root, depth, status. block: the fragment within a tree."""
    local = cut_lineage(map_fragments(nodes.withColumn("frag", block), ["tree", "frag"], ["pos", "id"], lambda g: contract(g, sums, paths), LOCAL))
    tops = local.filter("id = top and exit_up is not null").select("tree", "id", "pos", "exit_up", "exit_len", "lsum")
    at = local.select("tree", F.col("id").alias("exit_up"), F.col("top").alias("p_top"), F.col("dist").alias("p_dist"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), F.col("status").alias("p_status"), F.lit(True).alias("there"))
    found = tops.join(at, ["tree", "exit_up"], "left")
    missing = F.col("there").isNull()
    closed = missing | F.col("p_status").isNotNull()
    q = found.select(
        "tree", "id", "pos", F.when(~closed, F.col("p_top")).alias("up"), (F.col("exit_len") + F.coalesce("p_dist", F.lit(0))).alias("len"),
        F.coalesce("lsum", F.lit(0)).alias("w"), F.when(missing, F.col("id")).otherwise(F.col("p_root")).alias("root"),
        F.when(missing, F.lit(0)).otherwise(F.col("p_depth") + F.col("exit_len")).cast("long").alias("depth"),
        F.when(missing, "missing").otherwise(F.col("p_status")).alias("status"), "exit_up",
    )
    q = cut_lineage(q)
    n_q, n_open = q.agg(F.count("*"), F.count("up")).first()
    solved = None
    if n_open:
        core = q.drop("exit_up")
        if n_q <= small:
            solved = _solve(core, F.lit(0).cast("long"), n_q, block_width, sums, False, small)
        else:
            n_nodes = n_nodes or nodes.count()
            if n_nodes >= 2 * n_q:
                solved = _solve(*_ranked(core, block_width), n_q, block_width, sums, False, small)
            elif not sums:
                solved = _doubling(core)
            else:  # sums need fragments; ids spread evenly, so each group stays bounded
                solved = _merge_sums(core, _doubling(core))
    elif n_q:
        solved = q.select("tree", "id", "root", "depth", "status", F.col("w").alias("total"))
        if not sums:
            solved = solved.drop("total")
    keep = ["tree", "id", "up", "pos", "anchor", "tail"] if paths else ["tree", "id", "up", "pos"]
    if solved is None:
        out = local.select(*keep, "w", "top", "dist", "frag", "root", "depth", "status")
    else:
        s = solved.select("tree", F.col("id").alias("top"), F.col("root").alias("s_root"), F.col("depth").alias("s_depth"), F.col("status").alias("s_status"))
        is_open = local.filter("exit_up is not null").join(s, ["tree", "top"], "left").select(
            *keep, "w", "top", "dist", "frag", F.col("s_root").alias("root"), (F.col("s_depth") + F.col("dist")).alias("depth"), F.col("s_status").alias("status")
        )
        out = local.filter("exit_up is null").select(*keep, "w", "top", "dist", "frag", "root", "depth", "status").unionByName(is_open)
    if not sums:
        return out.select(*keep, "root", "depth", "status")
    extra = None
    if solved is not None:
        extra = (
            q.join(solved.select("tree", "id", "total"), ["tree", "id"]).filter("total is not null")
            .groupBy("tree", F.col("exit_up").alias("id")).agg(F.sum("total").alias("extra"))
        )
        inner = local.join(extra, ["tree", "id"], "left")
    else:
        inner = local.withColumn("extra", F.lit(None).cast("long"))
    totals = map_fragments(inner.select("tree", "frag", "id", "pos", "up", "w", "top", "dist", "extra"), ["tree", "frag"], ["pos", "id"], accumulate, "tree string, id string, total long")
    return out.select(*keep, "root", "depth", "status").join(totals, ["tree", "id"])


def _merge_sums(core: DataFrame, solved: DataFrame) -> DataFrame:
    """Subtree sums of a quotient that doesn't shrink: sums are pushed along doubled pointers, each round twice as far."""
    cur = cut_lineage(core.select("tree", "id", "up", F.col("w").alias("total")))
    rounds = core.count().bit_length() + 1
    for _ in range(rounds):
        if not cur.filter("up is not null").limit(1).count():
            break
        # total covers the descendants less than 2^k steps below, up is the ancestor 2^k above: the next 2^k come from those whose up this is
        below = cur.filter("up is not null").groupBy("tree", F.col("up").alias("id")).agg(F.sum("total").alias("more"))
        above = cur.select("tree", F.col("id").alias("up"), F.col("up").alias("next"))
        cur = cut_lineage(
            cur.join(below, ["tree", "id"], "left").join(above, ["tree", "up"], "left")
            .select("tree", "id", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        )
    return solved.join(cur.select("tree", "id", "total"), ["tree", "id"])


def resolve(nodes: DataFrame, weight: Column | None = None, paths: bool = False, block: int = BLOCK, small: int = SMALL, length: Column | None = None) -> DataFrame:
    """nodes: tree, id, up, pos, as from tree_nodes. Gives tree, id, up, pos, root, depth, status ('root', 'missing',
    'cycle'); with paths also anchor and tail; with weight also total, the sum of weight over the node's subtree. length:
    what the step from a node to its parent adds to depth (1).
    """
    start = F.col("up").isNull()
    n = nodes.select(
        "tree", "id", "pos", "up", (F.lit(1) if length is None else length).cast("long").alias("len"), (F.lit(0) if weight is None else weight).cast("long").alias("w"),
        F.when(start, F.col("id")).alias("root"), F.when(start, F.lit(0)).cast("long").alias("depth"), F.when(start, "root").alias("status"),
    )
    return _solve(n, F.floor(F.col("pos") / block).cast("long"), None, block, weight is not None, paths, small)


def hierarchy(df: DataFrame, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """Every node with parent, root, depth, status, number of descendants, place in preorder, and path as anchor and tail."""
    h = cut_lineage(resolve(tree_nodes(df), weight=F.lit(1), paths=True, block=block, small=small))
    sound = h.filter("status <> 'cycle'").select("tree", "id", "up", "pos", "total", (F.col("id") == F.col("root")).alias("is_top"))
    # a child comes after its parent and the subtrees of the siblings before it: one more path sum
    before = blocked.running_sum(sound.filter("not is_top"), ["tree", "up"], "pos", F.col("total"), "upto").select("tree", "id", "up", "pos", (F.col("upto") - F.col("total") + 1).alias("step"))
    tops = sound.filter("is_top").select("tree", "id", F.lit(None).cast("string").alias("up"), "pos", F.lit(0).cast("long").alias("step"))
    first = resolve(before.unionByName(tops), block=block, small=small, length=F.col("step")).select("tree", "id", F.col("depth").alias("first"))
    return h.join(first, ["tree", "id"], "left").select(
        F.col("tree").alias("session_id"), F.col("id").alias("uuid"), F.col("up").alias("parent_uuid"), "root", "depth", "status",
        (F.col("total") - 1).alias("n_descendants"), "first", F.when(F.col("status") != "cycle", F.col("anchor")).alias("path_anchor"),
        F.when(F.col("status") != "cycle", F.col("tail")).alias("path_tail"),
    )


def _climb(group: dict) -> dict:
    """The chains from the entries of one fragment to their local tops."""
    up = dict(zip(group["id"], group["up"]))
    out: dict = {"tree": [], "entry": [], "id": []}
    for i, is_entry in zip(group["id"], group["is_entry"]):
        x, seen = i if is_entry else None, set()
        while x in up and x not in seen:
            seen.add(x)
            out["tree"].append(group["tree"][0]), out["entry"].append(i), out["id"].append(x)
            x = up[x]
    return out


def _chains_doubled(q: DataFrame, targets: DataFrame) -> DataFrame:
    """As _chains, for quotients that contraction hardly shrinks: the steps known from each target double in every round."""
    met, hops = cut_lineage(targets.select("tree", "target", "id").distinct()), q.filter("up is not null").select("tree", "id", "up")
    n, n_before = met.count(), 0
    while n > n_before:
        further = met.join(hops, ["tree", "id"]).select("tree", "target", F.col("up").alias("id"))
        met = cut_lineage(met.unionByName(further).distinct())
        hops = cut_lineage(hops.join(hops.select("tree", F.col("id").alias("up"), F.col("up").alias("beyond")), ["tree", "up"]).select("tree", "id", F.col("beyond").alias("up")))
        n_before, n = n, met.count()
    return met


def _chains(nodes: DataFrame, block: Column, targets: DataFrame, width: int, small: int) -> DataFrame:
    """tree, target, id: the nodes on the way from each target (tree, target, id) up, targets included."""
    blank = {"len": F.lit(1).cast("long"), "w": F.lit(0).cast("long"), "root": F.lit(None).cast("string"), "depth": F.lit(None).cast("long"), "status": F.lit("root")}
    n = nodes.select("tree", "id", "pos", "up", block.alias("frag")).withColumns(blank)
    local = cut_lineage(map_fragments(n, ["tree", "frag"], ["pos", "id"], lambda g: contract(g, False, False), LOCAL).select("tree", "frag", "id", "pos", "up", "top", "exit_up"))
    entries = targets.select("tree", "target", F.col("id").alias("entry"))
    tops = local.filter("id = top and exit_up is not null").select("tree", "id", "pos", "exit_up")
    q = cut_lineage(tops.join(local.select("tree", F.col("id").alias("exit_up"), F.col("top").alias("up")), ["tree", "exit_up"]))  # no row: the parent isn't there
    n_q = q.count()
    if n_q:
        own = local.select("tree", F.col("id").alias("entry"), F.col("top").alias("id"))
        met = entries.join(own, ["tree", "entry"]).join(q.select("tree", "id"), ["tree", "id"], "left_semi").select("tree", "target", "id")
        if n_q > small and local.count() < 2 * n_q:
            met = _chains_doubled(q, met)
        else:
            rows, part = (q, F.lit(0).cast("long")) if n_q <= small else _ranked(q, width)
            met = _chains(rows, part, met, width, small)
        entries = entries.unionByName(met.join(q.select("tree", "id", "exit_up"), ["tree", "id"]).select("tree", "target", F.col("exit_up").alias("entry"))).distinct()
    entries = cut_lineage(entries)
    mark = entries.select("tree", F.col("entry").alias("id")).distinct().withColumn("is_entry", F.lit(True))
    marked = local.join(mark, ["tree", "id"], "left").select("tree", "frag", "id", "pos", "up", F.coalesce("is_entry", F.lit(False)).alias("is_entry"))
    used = marked.filter("is_entry").select("tree", "frag").distinct()
    # a plain repartition on the keys of the join is dropped, and adaptive plans then part fragments; this one is kept
    whole = marked.join(used, ["tree", "frag"], "left_semi").repartition(F.xxhash64("tree", "frag"))
    chains = map_fragments(whole, ["tree", "frag"], ["pos", "id"], _climb, "tree string, entry string, id string", spread=False)
    return entries.join(chains, ["tree", "entry"]).select("tree", "target", "id").distinct()  # where chains run into each other


def reach(nodes: DataFrame, targets: DataFrame, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """tree, target, id: what following parents from stated nodes (tree, id) of nodes (tree, id, up, pos) comes by, once
    each, in cycles too. A target that isn't there reaches nothing."""
    known = targets.select("tree", "id").distinct().join(nodes.select("tree", "id"), ["tree", "id"], "left_semi").select("tree", F.col("id").alias("target"), "id")
    return _chains(nodes, F.floor(F.col("pos") / block).cast("long"), known, block, small)


def paths(h: DataFrame, targets: DataFrame, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """Full paths of stated nodes (tree, id) of a resolved hierarchy: tree, target, depth, id, one row per node of a path.

    A target that isn't there, or lies in or below a cycle, has no path.
    """
    return _paths(_sound(h), targets, block, small)


def _sound(h: DataFrame) -> DataFrame:
    return cut_lineage(h.filter("status <> 'cycle'").select("tree", "id", "pos", "up", "depth"))


def _paths(sound: DataFrame, targets: DataFrame, block: int, small: int) -> DataFrame:
    found = reach(sound, targets, block, small)
    return found.join(sound.select("tree", "id", "depth"), ["tree", "id"]).select("tree", "target", "depth", "id")


def _ways(group: dict) -> dict:
    """The way of each node of one fragment from its local top down to it, and the local top's parent."""
    ids, ups = group["id"], group["up"]
    at = dict(zip(ids, range(len(ids))))
    ways: list = [None] * len(ids)
    exits: list = [None] * len(ids)
    for start in range(len(ids)):
        chain, i = [], start
        while i != -1 and ways[i] is None:
            chain.append(i)
            i = at.get(ups[i], -1)
        if chain:
            way, out = (ways[i], exits[i]) if i != -1 else ([], ups[chain[-1]])
            for c in reversed(chain):
                ways[c], exits[c] = way, out = [*way, ids[c]], out
    return {"tree": group["tree"], "id": ids, "depth": group["depth"], "exit_up": exits, "way": ways}


def every_path(h: DataFrame, piece: int = PIECE, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """Full paths of all nodes of a resolved hierarchy: tree, target, depth, id, one row per node of a path, the target included.

    A node in or below a cycle has no path. What is shuffled are nodes and the paths of the parents at the fragments'
    edges, never the rows of the result.
    """
    sound = _sound(h)
    within = map_fragments(
        sound.withColumn("frag", F.floor(F.col("pos") / piece)), ["tree", "frag"], ["pos", "id"], _ways,
        "tree string, id string, depth long, exit_up string, way array<string>", rows_out=1000,
    )
    edges = cut_lineage(within.filter("exit_up is not null").select("tree", F.col("id").alias("target"), "exit_up"))
    above = _paths(sound, edges.select("tree", F.col("exit_up").alias("id")), block, small)
    inner = within.select("tree", F.col("id").alias("target"), (F.col("depth") - F.size("way") + 1).alias("d"), F.posexplode("way").alias("i", "id"))
    outer = edges.join(above.withColumnRenamed("target", "exit_up"), ["tree", "exit_up"])
    return inner.select("tree", "target", (F.col("d") + F.col("i")).alias("depth"), "id").unionByName(outer.select("tree", "target", "depth", "id"))


def descendants(h: DataFrame, piece: int = PIECE, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """tree, id, descendant: all descendants of every node of a resolved hierarchy, one row each.

    In and below cycles too: there the descendants of a node are the other nodes from which following parents comes by it.
    """
    looped = cut_lineage(h.filter("status = 'cycle'").select("tree", "id", "pos", "up"))
    rows = every_path(h, piece, block, small).select("tree", "id", "target").unionByName(reach(looped, looped, block, small))
    return rows.filter("id <> target").select("tree", "id", F.col("target").alias("descendant"))
