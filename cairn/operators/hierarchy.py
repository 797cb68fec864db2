"""The density hierarchy: a minimum spanning tree, its condensed tree, and the clusters of greatest excess of mass.

A spanning tree's edges are contracted in rounds. What is left of a tree is finished on the driver once it has
at most SMALL edges, which bounds what the driver sees whatever the number of points.

1. tree(): each tile keeps a spanning forest; Boruvka rounds choose each component's lightest link among them.
2. basins(): a point leaves its cluster, seen from the root, at the weight at which its component first has
   min_cluster_size points. Components that are smaller hook along their lightest edge: two that choose each other
   merge, and whatever leads down to a large one is absorbed there, each at its own edge's weight.
3. merges(): edges between large components are the splits. Two that choose each other merge.
4. select(): stabilities from the leaves up, and the topmost stable clusters from the root down.

A tree of clusters of at most SMALL edges is broadcast, points climb it in jumps, and the driver selects; in a
larger one both go level by level, so that rounds follow its depth."""

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.tables import before, components, dealt_join, save
from cairn.operators.vectors import forest, nearest

#: Edges that the driver finishes, and the least weight of an edge in 1 / weight: copies have none.
SMALL, LEAST = 100_000, 1e-10


class _Sets:
    """Union-find over any keys."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _both(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: (node, edge), with the weight first, then the edge's name (u, v), so that no two are alike."""
    one = lambda a, b: edges.select(F.col(a).alias("node"), F.struct("w", "u", "v", F.col(b).alias("other")).alias("edge"))
    return one("a", "b").union(one("b", "a"))


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with the ends that names (node, new) renames; those within a node go."""
    for end in ("a", "b"):
        edges = edges.join(names.select(F.col("node").alias(end), F.col("new").alias("new_")), end, "left").withColumn(end, F.coalesce("new_", end)).drop("new_")
    return edges.where("a <> b").select("a", "b", "w", "u", "v")


def spanning(links: DataFrame) -> DataFrame:
    """(a, b, w) of the minimum spanning forest of links (id, neighbor, w); equal weights go by the ids."""
    ends = F.least("id", "neighbor"), F.greatest("id", "neighbor")
    edges = save(links.groupBy(ends[0].alias("a"), ends[1].alias("b")).agg(F.min("w").alias("w")).where("a <> b").select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")))
    spark, found = links.sparkSession, []
    while edges.count() > SMALL:
        light = save(_both(edges).groupBy("node").agg(F.min("edge").alias("edge")).select("node", "edge.*"))
        found.append(light.select(F.col("u").alias("a"), F.col("v").alias("b"), "w").distinct())
        parts = components(light, "node", "other").select("node", F.col("component").alias("new"))
        left = _renamed(edges, parts)
        pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        edges = save(left.groupBy(*pair).agg(F.min(F.struct("w", "u", "v")).alias("edge")).select("a", "b", "edge.*"))
    sets, rest = _Sets(), []
    for r in sorted(edges.collect(), key=lambda r: (r["w"], r["u"], r["v"])):
        x, y = sets.root(r["a"]), sets.root(r["b"])
        if x != y:
            sets.up[x] = y
            rest.append((r["u"], r["v"], r["w"]))
    out = spark.createDataFrame(rest, "a long, b long, w double")
    for one in found:
        out = out.union(one)
    return out


def tree(points: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w) of a minimum spanning tree of points by mutual reachability: the greatest of both core distances, to the min_samples-th nearest other point, and the distance."""
    core = nearest(points, points, min_samples).groupBy("id").agg(F.max("distance").alias("core"))
    dense = save(points.join(core, "id").select("id", "vec", "core"))
    return save(spanning(forest(dense, [])))


def _grown(edges: list, nodes: dict, least: int) -> tuple[dict, list]:
    """Edges (w, u, v, a, b) in ascending order, those of one weight together: (basin, weight) of each node (size, birth) that is no basin at the end, and edges between basins."""
    sets, small, basin, size, found, splits = _Sets(), {}, {}, {}, {}, []
    at_once: dict = defaultdict(list)
    for e in edges:
        at_once[e[0]].append(e[3:])
    for n, (m, birth) in nodes.items():
        size[n] = m
        if birth is None:
            small[n] = [n]
        else:
            basin[n] = n
    born = {n: birth for n, (_, birth) in nodes.items() if birth is not None}
    for w in sorted(at_once):
        parts: dict = {}
        for a, b in at_once[w]:
            x, y = sets.root(a), sets.root(b)
            parts[x] = parts.pop(x, [x]) + parts.pop(y, [y])
            sets.up[y] = x
        for x, roots in parts.items():
            old = sorted((basin[r] for r in roots if r in basin), key=lambda n: (born[n] == w, n))
            held = [n for r in roots for n in small.pop(r, [])]
            size[x] = sum(size[r] for r in roots)
            if not old and size[x] < least:
                small[x] = held
                continue
            own = old[0] if old else min(held)
            born.setdefault(own, w)
            for n in old[1:]:
                if born[n] == w:  # it was born on this very weight, and is none of its own
                    held.append(n)
                else:
                    splits.append((own, n, w, own, n))
            found.update((n, (own, w)) for n in held if n != own or not old)
            basin[x] = own
    return found, splits


def basins(points: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, basin, b): where and at which weight each point joins a component of `least` points (none: in no row); and edges (a, b, w, u, v) between basins.

    A component that reaches `least` on the very weight at which it meets another such one is no basin of its own."""
    spark = points.sparkSession
    edges = save(edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = save(points.select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"), (F.lit(0.0) if least <= 1 else F.lit(None).cast("double")).alias("birth")))
    members = nodes.select(F.col("node").alias("id"), "node", F.col("birth").alias("b"))
    few = False
    while not few:
        few = edges.count() <= SMALL
        if few:
            on = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            held = {r["node"]: (r["size"], r["birth"]) for r in nodes.join(on, "node").collect()}
            found, splits = _grown(sorted((r["w"], r["u"], r["v"], r["a"], r["b"]) for r in edges.collect()), held, least)
            names = spark.createDataFrame([(n, *x) for n, x in found.items()], "node long, new long, b double")
            splits = spark.createDataFrame(splits, "a long, b long, w double, u long, v long")
        else:
            light = _both(edges).groupBy("node").agg(F.min("edge").alias("edge")).join(nodes, "node").select("node", "size", "birth", "edge.*")
            hook = save(light.where(F.col("birth").isNull() | (F.col("birth") == F.col("w"))))
            if hook.isEmpty():
                splits = edges
                break
            back = hook.select(F.col("node").alias("other"), F.col("other").alias("node"), F.col("size").alias("size_"))
            pairs = save(hook.join(back, ["node", "other"]).select("node", F.least("node", "other").alias("new"), (F.col("size") + F.col("size_")).alias("size"), "w"))
            up = save(hook.join(pairs.select("node", F.col("node").alias("self")), "node", "left").select("node", F.coalesce("self", "other").alias("up")))
            while True:  # pointer jumping; a root is a pair's node, or a large one, which isn't in the table
                higher = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
                jumped = save(up.join(higher, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
                up = jumped.drop("moved")
                if jumped.where("moved").isEmpty():
                    break
            small = hook.select(F.col("node").alias("up"))
            absorbed = up.join(small, "up", "left_anti").join(hook.select("node", "w"), "node").select("node", F.col("up").alias("new"), F.col("w").alias("b"))
            merged = pairs.select("node", "new", F.when(F.col("size") >= least, F.col("w")).alias("b"))
            names = absorbed.union(merged)
        names = save(names)
        named = members.join(names.withColumnRenamed("b", "b_"), "node", "left")
        members = save(named.select("id", F.coalesce("new", "node").alias("node"), F.coalesce("b", "b_").alias("b")))
        if not few:
            sized = nodes.join(names.select("node", "new", "b"), "node", "left").groupBy(F.coalesce("new", "node").alias("node"))
            nodes = save(sized.agg(F.sum("size").alias("size"), F.coalesce(F.min(F.when(F.col("new").isNull(), F.col("birth"))), F.max(F.when(F.col("node") == F.col("new"), F.col("b")))).alias("birth")))
            edges = save(_renamed(edges, names))
    return members.where("b IS NOT NULL").select("id", F.col("node").alias("basin"), "b"), save(splits)


def merges(splits: DataFrame, leaves: DataFrame) -> DataFrame:
    """(child, parent, w): the tree of clusters over leaves (basin); the least weight at which two are one. Clusters are named by a basin and the round."""
    spark = splits.sparkSession
    name = F.concat_ws(":", F.col("node").cast("string"), F.lit("0"))
    held = save(leaves.select(F.col("basin").alias("node")).distinct().select("node", name.alias("cluster")))
    edges, found, nth = splits, [], 0
    while edges.count() > SMALL:
        nth += 1
        light = save(_both(edges).groupBy("node").agg(F.min("edge").alias("edge")).select("node", "edge.*"))
        pairs = save(light.join(light.select(F.col("node").alias("other"), F.col("other").alias("node")), ["node", "other"]).select("node", F.least("node", "other").alias("new"), "w"))
        parent = F.concat_ws(":", F.col("new").cast("string"), F.lit(str(nth)))
        found.append(save(pairs.join(held, "node").select(F.col("cluster").alias("child"), parent.alias("parent"), "w")))
        moved = held.join(pairs.select("node", "new"), "node", "left")
        held = save(moved.select(F.coalesce("new", "node").alias("node"), F.when(F.col("new").isNull(), F.col("cluster")).otherwise(parent).alias("cluster")).distinct())
        edges = save(_renamed(edges, pairs.select("node", "new")))
    on = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = {r["node"]: r["cluster"] for r in held.join(on, "node").collect()}
    sets, rest = _Sets(), []
    for r in sorted(edges.collect(), key=lambda r: (r["w"], r["u"], r["v"])):
        x, y = sets.root(r["a"]), sets.root(r["b"])
        nth += 1
        rest += [(own[x], f"{x}:{nth}", r["w"]), (own[y], f"{x}:{nth}", r["w"])]
        sets.up[y] = x
        own[x] = f"{x}:{nth}"
    out = spark.createDataFrame(rest, "child string, parent string, w double")
    for one in found:
        out = out.union(one)
    return save(out)


def _inverse(w) -> F.Column:
    return 1 / F.greatest(w, F.lit(LEAST))


def entered(members: DataFrame, up: DataFrame) -> DataFrame:
    """(id, cluster, b): the cluster that each point falls out of, going up from its basin past the merges up to b."""
    now = members.select("id", F.concat_ws(":", F.col("basin").cast("string"), F.lit("0")).alias("cluster"), "b")
    done = []
    while True:
        step = save(now.join(up.select(F.col("child").alias("cluster"), "parent", "w"), "cluster", "left").withColumn("on", F.coalesce(F.col("w") <= F.col("b"), F.lit(False))))
        done.append(step.where("NOT on").select("id", "cluster", "b"))
        now = step.where("on").select("id", F.col("parent").alias("cluster"), "b")
        if now.isEmpty():
            break
    out = done[0]
    for one in done[1:]:
        out = out.union(one)
    return save(out)


def stabilities(entries: DataFrame, up: DataFrame) -> DataFrame:
    """(cluster, parent, n, stability, stable): n points and the excess of mass of every cluster but the root; stable says that it is at least that of its best descendants together."""
    own = entries.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(_inverse(F.col("b"))).alias("mass"))
    splits = up.groupBy(F.col("parent").alias("cluster")).agg(F.max("w").alias("split"), F.count("*").alias("children"))
    every = up.select(F.col("child").alias("cluster"), "parent", "w").join(own, "cluster", "left").join(splits, "cluster", "left").fillna(0, ["m", "mass", "children"])
    left, done = save(every), None
    ready = left.where("children = 0").withColumn("n_", F.lit(0).cast("long")).withColumn("best_", F.lit(0.0))
    while True:
        n, birth = F.col("m") + F.col("n_"), _inverse(F.col("w"))
        grown = ready.withColumn("n", n).withColumn("stability", F.col("mass") + F.coalesce(F.col("n_") * _inverse(F.col("split")), F.lit(0.0)) - n * birth)
        level = save(grown.select("cluster", "parent", "n", "stability", (F.col("stability") >= F.col("best_")).alias("stable"), F.greatest("stability", "best_").alias("best")))
        done = level if done is None else save(done.union(level))
        both = done.groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("known"), F.sum("n").alias("n_"), F.sum("best").alias("best_"))
        ready = left.join(done.select("cluster"), "cluster", "left_anti").join(both, "cluster").where("known = children").drop("known")
        if ready.isEmpty():
            return done.drop("best")


def select(known: DataFrame) -> DataFrame:
    """(cluster, chosen): of each cluster but the root the topmost stable one that it is in, or NULL."""
    level = save(known.join(known.select(F.col("cluster").alias("parent")), "parent", "left_anti").select("cluster", F.when(F.col("stable"), F.col("cluster")).alias("chosen")))
    done = level
    while True:
        above = level.select(F.col("cluster").alias("parent"), "chosen")
        level = save(known.join(above, "parent").select("cluster", F.coalesce("chosen", F.when(F.col("stable"), F.col("cluster"))).alias("chosen")))
        if level.isEmpty():
            return done
        done = save(done.union(level))


class _Known:
    """A tree of clusters (child, parent, w) on the driver: up and w of each node, the root's being itself and inf."""

    def __init__(self, rows: list):
        self.names = sorted({x for r in rows for x in (r["child"], r["parent"])})
        self.at = {x: i for i, x in enumerate(self.names)}
        self.up, self.w = np.arange(len(self.names)), np.full(len(self.names), np.inf)
        for r in rows:
            self.up[self.at[r["child"]]], self.w[self.at[r["child"]]] = self.at[r["parent"]], r["w"]

    def jumps(self) -> list:
        """(node, weight of the last edge) 1, 2, 4 ... edges up; weights don't fall on the way."""
        out = [(self.up, self.w)]
        while (out[-1][0] != out[-1][0][out[-1][0]]).any():
            up, w = out[-1]
            out.append((up[up], w[up]))
        return out

    def chosen(self, own: list) -> list:
        """(cluster, chosen) by the points that fall out of each cluster: own (cluster, m, mass)."""
        size = len(self.names)
        n, mass, split, inner, best = np.zeros(size), np.zeros(size), np.full(size, np.inf), np.zeros(size), np.zeros(size)
        depth, at = (self.up != np.arange(size)).astype(int), self.up
        while (at != at[at]).any():
            depth, at = depth + depth[at], at[at]
        for r in own:
            n[self.at[r["cluster"]]], mass[self.at[r["cluster"]]] = r["m"], r["mass"]
        stable, order = np.zeros(size, bool), np.argsort(-depth, kind="stable")
        for i in order[depth[order] > 0]:
            stability = mass[i] + inner[i] / max(split[i], LEAST) - (n[i] + inner[i]) / max(self.w[i], LEAST)
            n[i] += inner[i]
            stable[i] = stability >= best[i]
            p = self.up[i]
            inner[p] += n[i]
            best[p] += max(stability, best[i])
            split[p] = max(self.w[i], split[p]) if np.isfinite(split[p]) else self.w[i]
        top = np.full(size, -1)
        for i in order[::-1]:
            if depth[i]:
                top[i] = top[self.up[i]] if top[self.up[i]] >= 0 else i if stable[i] else -1
        return [(self.names[i], self.names[top[i]]) for i in range(size) if top[i] >= 0]


def _climbed(members: DataFrame, known: _Known) -> DataFrame:
    """entered() by a tree that every task holds."""
    sent = members.sparkSession.sparkContext.broadcast((known.names, known.at, known.jumps()))

    def run(batches):
        names, places, jumps = sent.value
        for pdf in batches:
            at, b = np.array([places[f"{x}:0"] for x in pdf["basin"]], int), pdf["b"].to_numpy(dtype=float)
            for up, w in reversed(jumps):
                at = np.where(w[at] <= b, up[at], at)
            yield pd.DataFrame({"id": pdf["id"], "cluster": [names[i] for i in at], "b": b})

    return save(members.mapInPandas(run, "id long, cluster string, b double"))


def numbered(points: DataFrame, labels: DataFrame, least: int = 1) -> DataFrame:
    """(id, cluster) of all points: labels (id, label) of at least `least` points are numbered by size, then least label; -1 for the rest."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= least)
    bigger = before(sizes.groupBy((-F.col("n")).alias("size")).agg(F.count("*").alias("m")), "size", F.col("m"))
    with_size = sizes.withColumn("size", -F.col("n")).join(bigger, "size")
    numbers = with_size.withColumn("cluster", F.col("before") + F.row_number().over(Window.partitionBy("size").orderBy("first")) - 1)
    own = dealt_join(labels, numbers.select("label", "cluster"), "label", "id").select("id", "cluster")
    return points.select("id").join(own, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def from_tree(points: DataFrame, edges: DataFrame, min_cluster_size: int) -> DataFrame:
    """(id, cluster) of points by the spanning tree edges (a, b, w); see clusters()."""
    members, splits = basins(points, edges, min_cluster_size)
    up = merges(splits, members)
    if up.isEmpty():
        return points.select("id", F.lit(-1).alias("cluster"))
    rows = up.limit(SMALL + 1).collect()
    if len(rows) <= SMALL:
        known = _Known(rows)
        entries = _climbed(members, known)
        own = entries.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(_inverse(F.col("b"))).alias("mass")).collect()  # SMALL at most
        chosen = points.sparkSession.createDataFrame(known.chosen(own), "cluster string, chosen string")
    else:
        entries = entered(members, up)
        chosen = select(stabilities(entries, up))
    labels = dealt_join(entries, chosen.where("chosen IS NOT NULL"), "cluster", "id").select("id", F.col("chosen").alias("label"))
    return numbered(points, save(labels))


def clusters(points: DataFrame, min_samples: int, min_cluster_size: int) -> DataFrame:
    """(id, cluster): the clusters of greatest excess of mass of the density hierarchy, without a distance to be given.

    Numbered by size, then least id; -1 for noise. The root is no cluster, so that points without two groups of
    min_cluster_size are all noise, as are fewer points than that. Weights under 1e-10 count as that much.
    A point on the very weight of a split belongs to what is above it, so that ties between links don't matter."""
    return from_tree(points, tree(points, min_samples), min_cluster_size)
