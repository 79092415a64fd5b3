"""Near-duplicate vectors: dense groups compared exactly, the rest by a forest of random-projection trees with spill.

Splits at medians would cut a large group of near copies at every level.  So dense groups are taken out first: around
sample vectors that link with many of the sample, centres are laid.  A vector within the link's angle of a centre is at
home with the nearest one; whatever links with it lies within twice that angle of the same centre, and visits it.  Homes
are compared with homes and visitors in blocks, which count links and keep one edge for each vector joined, so no pair is
listed and none is missed.

The other vectors go through the forest.
Trees are fitted on a bounded sample (``sample`` vectors, those whose id hashes lowest): each node draws a random
direction and splits at the sample's median; vectors within the spill band around it, a fixed share of the node's sample,
go both ways.  Every vector is then taken down every tree.  Where the sample is too small for trees as deep as the table
needs, leaves of more than ``leaf_most`` vectors are fitted anew, each on a sample of its own, in rounds, so leaves stay
bounded at any size.  Vectors that share a leaf are compared by cosine in double precision, and the links of all leaves are
united.  There are more trees where they are deep.  A link is missed only if neither vector is at home with a centre and
every tree parts the two.

Equal vectors share one representative, so a group of copies costs one vector.

Defined results.  A vector that is null, empty, zero, or holds a null or non-finite component links with nothing.  Vectors
of different lengths do not link.  Null ids: no links, component null, kept.  Rows repeated with one id count as one
vector each.  Empty table: no rows.  Other columns, labels among them, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle
from .components import components

PACKED = pa.schema([("size", pa.int32()), ("centre", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("homeless", pa.binary()), ("vs", pa.binary())])


class Tree:
    """Splits in level order: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int, spill: float, rng: np.random.Generator):
        nodes = (1 << depth) - 1
        self.depth = depth
        self.direction = rng.standard_normal((nodes, sample.shape[1]))
        self.at, self.band = np.zeros(nodes), np.zeros(nodes)
        members = {0: np.arange(len(sample))}
        for i in range(nodes):
            own = members.pop(i, np.empty(0, np.int64))
            p = sample[own] @ self.direction[i]
            if len(own):
                self.at[i] = np.median(p)
                self.band[i] = np.quantile(np.abs(p - self.at[i]), spill)
            if 2 * i + 2 < nodes:
                members[2 * i + 1], members[2 * i + 2] = own[p < self.at[i]], own[p >= self.at[i]]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row reaches."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", x[row], self.direction[node]) - self.at[node]
            left, right = p < self.band[node], p >= -self.band[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node


DEALT = "size int, tree int, leaf long, id long, copies long, v binary"
#: Vectors of a leaf's own sample, vectors that a task takes down a leaf's tree, deepest tree of a leaf, rounds at most.
LEAF_SAMPLE, LEAF_PART, LEAF_DEPTH, LEAF_ROUNDS = 2048, 100_000, 10, 5


def deepened(dealt: DataFrame, leaf: int, leaf_most: int, spill: float, seed: int) -> DataFrame:
    """dealt (size, tree, leaf, id, copies, v) with leaves of more than leaf_most vectors taken apart by trees of their own."""
    keys, done = ["size", "tree", "leaf"], None
    names = [c.split()[0] for c in DEALT.split(", ")]
    vectors = lambda table: _unit([np.frombuffer(v) for v in table["v"].to_pylist()])
    draws = lambda size, tree, leaf: np.random.default_rng([seed, size, tree, leaf])

    def fit(key, table):
        size, tree, own = (k.as_py() for k in key)
        x = vectors(table.sort_by("id"))
        depth = max(1, min(LEAF_DEPTH, math.ceil(math.log2(table["n"][0].as_py() / leaf)), int(math.log2(max(2, len(x) / 16)))))
        fitted = Tree(x, depth, spill, draws(size, tree, own))
        return pa.table({"size": pa.array([size], pa.int32()), "tree": pa.array([tree], pa.int32()), "leaf": pa.array([own], pa.int64()), "n": table["n"].slice(0, 1), "depth": pa.array([depth], pa.int32()), "at": pa.array([fitted.at.tobytes()], pa.binary()), "band": pa.array([fitted.band.tobytes()], pa.binary())})

    def descend(key, table, trees):
        if not len(table) or not len(trees):
            return table.slice(0, 0).select(names)
        size, tree, own = (k.as_py() for k in key[:3])
        # Directions are drawn again, as they were when the tree was fitted; the sample only sets where it splits.
        fitted = Tree(np.empty((0, size)), trees["depth"][0].as_py(), spill, draws(size, tree, own))
        fitted.at, fitted.band = (np.frombuffer(trees[c][0].as_py()) for c in ("at", "band"))
        row, node = fitted.leaves(vectors(table))
        found = table.select(names).take(pa.array(row))
        return found.set_column(2, "leaf", pa.array((own << LEAF_DEPTH + 1) + node + 1, pa.int64()))

    for _ in range(LEAF_ROUNDS):
        dealt = settle(dealt, "dealt")
        large = settle(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_most), "large")
        if large.isEmpty():
            break
        small = dealt.join(large, keys, "left_anti").select(*names)
        done = small if done is None else done.unionByName(small)
        rows = dealt.join(large, keys)
        drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) * F.col("n") < (LEAF_SAMPLE << 30))
        trees = settle(drawn.groupBy(*keys).applyInArrow(fit, "size int, tree int, leaf long, n long, depth int, at binary, band binary"), "trees")
        parts = F.ceil(F.col("n") / LEAF_PART).cast("int")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).groupBy(*keys, "part")
        trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).groupBy(*keys, "part")
        dealt = rows.cogroup(trees).applyInArrow(descend, DEALT)
    return dealt if done is None else done.unionByName(dealt)


def _halves(x: np.ndarray, own: np.ndarray, most: int, spill: float, rng: np.random.Generator, deep: int = 0):
    """Parts of a large leaf, by further random splits; one that splits do not make smaller stays whole."""
    if len(own) <= most or deep > 40:
        yield own
        return
    p = x[own] @ rng.standard_normal(x.shape[1])
    at = np.median(p)
    band = np.quantile(np.abs(p - at), spill)
    left, right = own[p - at <= band], own[p - at >= -band]
    if max(len(left), len(right)) > 0.9 * len(own):
        yield own
        return
    yield from _halves(x, left, most, spill, rng, deep + 1)
    yield from _halves(x, right, most, spill, rng, deep + 1)


def _linked(x: np.ndarray, least: float, block: int = 1024):
    """(i, j) with i < j whose cosine is at least least; x has unit rows."""
    for a in range(0, len(x), block):
        for b in range(a, len(x), block):
            i, j = np.nonzero(x[a : a + block] @ x[b : b + block].T >= least)
            ahead = i + a < j + b
            yield i[ahead] + a, j[ahead] + b


def _centres(x: np.ndarray, least: float, members: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the dense groups of a sample (unit rows), and which of its vectors are at home with none of them.

    Taken greedily: around the vector that links with most of the sample not yet at home, until none links with members.
    """
    linked, centres = np.zeros(len(x), np.int64), []
    for a in range(0, len(x), 1024):
        for b in range(0, len(x), 1024):
            linked[a : a + 1024] += (x[a : a + 1024] @ x[b : b + 1024].T >= least).sum(axis=1)
    free = np.ones(len(x), bool)
    while len(x) and (top := int(np.argmax(np.where(free, linked, -1)))) >= 0 and free[top] and linked[top] >= members:
        near = x[free & (x @ x[top] >= least)]
        centre = near.mean(axis=0)
        centre /= np.sqrt(centre @ centre) or 1.0
        # The middle of the group, unless the vector itself reaches more.
        if (x[top] @ centre < least) or (x[free] @ centre >= least).sum() < len(near):
            centre = x[top]
        home = free & (x @ centre >= least)
        home[top] = True
        centres.append(centre)
        free &= ~home
        gone = x[home]
        for a in range(0, len(x), 1024):
            for b in range(0, len(gone), 1024):
                linked[a : a + 1024] -= (x[a : a + 1024] @ gone[b : b + 1024].T >= least).sum(axis=1)
    return np.array(centres).reshape(-1, x.shape[1]), free


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the smallest that edges (a, b) link it with."""
    root = np.arange(n)
    while True:  # labels sink to the smallest that a link or a label's own label reaches
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def link_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 16, leaf: int = 200, leaf_most: int = 2000, spill: float = 0.08, sample: int = 16384, seed: int = 7, block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("v"))
    by_vector = settle(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")), "vectors")
    n = by_vector.count()
    forests, middles, shallow = {}, {}, False
    drawn = by_vector.select(F.col("v")).orderBy(F.xxhash64("first"), "first").limit(sample).toPandas()["v"].tolist() if n else []
    for size in sorted({len(x) for x in drawn}):
        own = _unit([x for x in drawn if len(x) == size])
        # Groups of fewer than half a leaf are left to the trees, and those of which the sample shows too little.
        middles[size], free = _centres(own, least, max(8, math.ceil(leaf / 2 * len(drawn) / n)))
        own = own[free]
        levels = math.ceil(math.log2(max(1, n * len(own) / len(drawn) / leaf)))
        depth = max(0, min(levels, int(math.log2(max(1, len(own) / 16)))))
        shallow |= depth < levels
        forests[size] = [Tree(own, depth, spill, np.random.default_rng([seed, size, t])) for t in range(max(trees, math.ceil(trees * levels / 8)))]
    # Cosine of twice the angle of a link, less what rounding may cost.
    reach = 2 * least * least - 1 - 1e-9 if least > 0 else -2.0

    def place(batches):
        """A row for the home of each vector, centre -1 where it has none, and one for each other centre it visits."""
        for batch in batches:
            ids, copies, values = batch.column("first").to_numpy(), batch.column("copies").to_numpy(), batch.column("v").to_pylist()
            sizes = np.array([len(x) for x in values])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                raw = [np.array(values[i], np.float64).tobytes() for i in at]
                home, row, visited = np.full(len(at), -1), np.empty(0, np.int64), np.empty(0, np.int64)
                if len(middles.get(size, ())):
                    near = _unit([values[i] for i in at]) @ middles[size].T
                    first = near.argmax(axis=1)
                    home = np.where(near.max(axis=1) >= least, first, -1)
                    row, visited = np.nonzero((near >= reach) & (np.arange(near.shape[1]) != home[:, None]))
                row, centre = np.concatenate([np.arange(len(at)), row]), np.concatenate([home, visited])
                visitor = np.arange(len(row)) >= len(at)
                yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(row), size), pa.int32()), "centre": pa.array(centre, pa.int32()), "visitor": pa.array(visitor), "homeless": pa.array(home[row] < 0), "id": pa.array(ids[at][row], pa.int64()), "copies": pa.array(copies[at][row], pa.int64()), "v": pa.array([raw[i] for i in row], pa.binary())})

    def pack(key, table):
        order = table.sort_by("id")
        column = lambda name, kind: order[name].to_numpy().astype(kind).tobytes()
        return pa.table({"size": [key[0].as_py()], "centre": [key[1].as_py()], "part": [key[2].as_py()], "ids": [column("id", np.int64)], "copies": [column("copies", np.int64)], "homeless": [column("homeless", np.int64)], "vs": [b"".join(order["v"].to_pylist())]}, schema=PACKED)

    def meet(key, table):
        """Links of two blocks of a centre, or within one: counted, and united to roots. part counts homes first, then visitors."""
        order = table.sort_by("part")
        parts, low, high = order["part"].to_pylist(), key[2].as_py(), key[3].as_py()
        schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("others", pa.int64())])
        if parts != sorted({low, high}):
            return pa.table({"id": [], "root": [], "others": []}, schema=schema)
        ids, copies, homeless = ([np.frombuffer(x, np.int64) for x in order[name].to_pylist()] for name in ("ids", "copies", "homeless"))
        x = [np.frombuffer(raw).reshape(len(i), -1) for raw, i in zip(order["vs"].to_pylist(), ids)]
        x = [y / np.sqrt((y * y).sum(axis=1, keepdims=True)) for y in x]
        visited = bool(order["visited"].to_pylist()[-1])
        # A visitor at home elsewhere is counted there by the homes it meets here.
        weigh = copies[-1] * homeless[-1] if visited else copies[-1]
        left, right = len(ids[0]), len(ids[-1])
        shift = left if low != high else 0
        others, root = np.zeros(shift + right, np.int64), np.arange(shift + right)
        for a in range(0, left, 1024):
            for b in range(0, right, 1024):
                hit = x[0][a : a + 1024] @ x[-1][b : b + 1024].T >= least
                rows, cols = slice(a, a + hit.shape[0]), slice(shift + b, shift + b + hit.shape[1])
                if low == high and a == b:
                    np.fill_diagonal(hit, False)
                others[rows] += (hit.astype(np.float64) @ weigh[b : b + 1024]).astype(np.int64)
                if low != high:
                    others[cols] += (copies[0][a : a + 1024] @ hit.astype(np.float64)).astype(np.int64)
                i, j = np.nonzero(hit & (root[rows][:, None] != root[cols][None, :]))
                if len(i):
                    root = _roots(root[rows][i], root[cols][j], len(root))[root]
        all_ids = np.concatenate(ids)
        said = np.flatnonzero((others > 0) | (root != np.arange(len(root))))
        return pa.table({"id": all_ids[said], "root": all_ids[root[said]], "others": others[said]}, schema=schema)

    def deal(batches):
        for batch in batches:
            ids, copies, values = batch.column("id").to_numpy(), batch.column("copies").to_numpy(), batch.column("v").to_pylist()
            sizes = np.array([len(x) for x in values]) // 8
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                raw = [values[i] for i in at]
                x = _unit([np.frombuffer(y) for y in raw])
                # A length that the sample has not met is one leaf.
                for t, tree in enumerate(forests.get(size, [None] * trees)):
                    row, node = tree.leaves(x) if tree else (np.arange(len(at)), np.zeros(len(at), np.int64))
                    yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(row), size), pa.int32()), "tree": pa.array(np.full(len(row), t), pa.int32()), "leaf": pa.array(node, pa.int64()), "id": pa.array(ids[at][row], pa.int64()), "copies": pa.array(copies[at][row], pa.int64()), "v": pa.array([raw[i] for i in row], pa.binary())})

    def compare(key, table):
        order = table.sort_by("id")
        ids, copies = order["id"].to_numpy(), order["copies"].to_numpy()
        x = np.frombuffer(b"".join(order["v"].to_pylist())).reshape(len(ids), -1)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        rng = np.random.default_rng([seed, *[k.as_py() for k in key]])
        found = [(own[i], own[j]) for own in _halves(x, np.arange(len(ids)), leaf_most, spill, rng) for i, j in _linked(x[own], least) if len(i)]
        schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("near", pa.list_(pa.struct([("id", pa.int64()), ("copies", pa.int64())])))])
        if not found:
            return pa.table({"id": [], "root": [], "near": []}, schema=schema)
        a, b = np.unique(np.stack([np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])]), axis=1)
        root = _roots(a, b, len(ids))
        one, two = np.concatenate([a, b]), np.concatenate([b, a])
        by = np.argsort(one, kind="stable")
        one, two = one[by], two[by]
        who, start = np.unique(one, return_index=True)
        near = pa.ListArray.from_arrays(pa.array(np.append(start, len(one)), pa.int32()), pa.StructArray.from_arrays([pa.array(ids[two]), pa.array(copies[two])], ["id", "copies"]))
        return pa.table({"id": pa.array(ids[who]), "root": pa.array(ids[root[who]]), "near": near}, schema=schema)

    placed = settle(by_vector.mapInArrow(place, "size int, centre int, visitor boolean, homeless boolean, id long, copies long, v binary"), "placed")
    at_centres = placed.where("centre >= 0")
    parts = at_centres.groupBy("size", "centre").agg(*[F.ceil(F.count_if(c) / block).cast("int").alias(k) for k, c in (("homes", ~F.col("visitor")), ("visits", F.col("visitor")))])
    within = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    packed = at_centres.join(F.broadcast(parts), ["size", "centre"]).where("homes > 0").withColumn("part", F.when(F.col("visitor"), F.col("homes") + within("visits")).otherwise(within("homes")))
    packed = settle(packed.groupBy("size", "centre", "part").applyInArrow(pack, "size int, centre int, part int, ids binary, copies binary, homeless binary, vs binary"), "packed").join(F.broadcast(parts), ["size", "centre"])
    # Homes meet all blocks of their centre, visitors meet the homes alone.
    met = packed.withColumn("visited", F.col("part") >= F.col("homes")).withColumn("with", F.explode(F.expr("sequence(0, IF(visited, homes, homes + visits) - 1)")))
    met = met.select("size", "centre", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "visited", "ids", "copies", "homeless", "vs")
    dense = settle(met.groupBy("size", "centre", "low", "high").applyInArrow(meet, "id long, root long, others long"), "dense")
    dealt = placed.where("centre < 0").mapInArrow(deal, DEALT)
    if shallow:
        dealt = deepened(dealt, leaf, leaf_most, spill, seed)
    found = settle(dealt.groupBy("size", "tree", "leaf").applyInArrow(compare, "id long, root long, near array<struct<id:long,copies:long>>"), "near")
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(dense.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    near = F.array_distinct(F.flatten(F.collect_list("near")))
    others = found.groupBy("id").agg(F.aggregate(near, F.lit(0).cast("long"), lambda s, x: s + x.getField("copies")).alias("others"))
    others = others.unionByName(dense.select("id", "others")).groupBy("id").agg(F.sum("others").alias("others"))
    known = by_vector.join(others.withColumnRenamed("id", "first"), "first", "left").join(linked.withColumnRenamed("id", "first"), "first", "left")
    known = known.select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "first").alias("c"))
    component = F.coalesce("c", "vec_id")
    return rows.join(known, "v", "left").select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
