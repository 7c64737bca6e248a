"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors are one class from the start. Classes are dealt to overlapping cluster
shards in two levels: to the nearest of at most `clusters` centres, from k-means on a
bounded sample, and within a cluster to the nearest of its own centres, from k-means
on a bounded sample of the cluster, as many as keep a shard near `shard_rows`. (A
shard that is still larger, since its vectors are too much alike, is cut into blocks,
and a query visits all of them.) In each shard a graph is built whose out-neighbours
are robustly pruned; a class's neighbours from all of its shards are united. Every
class is then a query in the shards nearest to it, and in all whose border lies within
reach: a vector that is similar enough stands beyond a border by the sine of the angle
at most, and seldom by more than `SPREAD` standard deviations of a random direction's
share of it; that is what decides, so that a crowd which fills many shards is searched
in all of them. There, a greedy search from the shard's
medoids, and from the class's own neighbours, descends to its neighbourhood, and the
range expands from each vector found within it until nothing new is. What is found
is verified by the cosine in double precision.

A pair that several shards could find is counted in one of them, the first of the
vector's shards that the query visits; the query enters it by its united neighbours,
so that what one shard knows helps in the others. A shard works off its queries a
few at a time and reports links as counts, and as one edge per class to the smallest
class it hangs together with: no list of pairs outlives its few queries, however
dense a shard is. `audit` measures the recall of the counts against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle, sweep
from .graph import components

DEGREE, POOL, ALPHA, MEDOIDS, BEAM = 32, 64, 1.2, 8, 12
SPREAD = 1.5


def _classes(batches):
    """(id, node, vector): node is a hash of the vector's numbers, null if the vector can link with nothing."""
    for batch in batches:
        nodes, raws = [], []
        for v in batch.column(1).to_pylist():
            node = raw = None
            if v and None not in v:
                x = np.array(v, np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else None
                if x is not None:
                    raw = np.array(v, "<f8").tobytes()
                    node = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
            nodes.append(node)
            raws.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(raws, pa.binary())], names=["vec_id", "node", "raw"])


def unit(raws: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f8") for r in raws])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    if len(sample) <= n:
        return sample
    middle = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        best = (sample @ middle.T).argmax(1)
        total = np.zeros_like(middle)
        np.add.at(total, best, sample)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        middle = np.where(norm > 0, total / np.maximum(norm, 1e-12), middle)
    return middle


def visited(x: np.ndarray, middle: np.ndarray, least: float, probes: int) -> list[np.ndarray]:
    """For each unit vector the unit centres whose cells it visits, nearest first: the `probes` nearest, and those whose border is within reach."""
    like = x @ middle.T
    reach = math.sqrt(max(0.0, 1 - least * least)) * min(1.0, SPREAD / math.sqrt(max(1, x.shape[1] - 1)))
    order = np.argsort(-like, axis=1, kind="stable")
    out = []
    for i, by in enumerate(order):
        first = by[0]
        gap = np.sqrt(np.maximum(1e-18, 2 - 2 * (middle @ middle[first])))
        near = like[i, first] - like[i] <= reach * gap
        near[by[:probes]] = True
        out.append(by[near[by]])
    return out


def pruned(x: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Robustly pruned out-neighbours of each vector: from the nearest and some random ones, one is kept unless a kept one is ALPHA times closer to it."""
    n, rng = len(x), np.random.default_rng(seed)
    out: list[np.ndarray] = []
    for low in range(0, n, 512):
        like = x[low : low + 512] @ x.T
        like[np.arange(len(like)), np.arange(low, low + len(like))] = -3
        near = np.argpartition(-like, min(POOL, n - 1) - 1, axis=1)[:, : min(POOL, n - 1)] if n > 1 else np.zeros((len(like), 0), int)
        for i in range(len(like)):
            pool = np.unique(np.concatenate([near[i], rng.integers(0, n, POOL // 2)]))
            pool = pool[pool != low + i]
            far = np.sqrt(np.maximum(0, 2 - 2 * like[i, pool]))
            order = np.argsort(far, kind="stable")
            pool, far = pool[order], far[order]
            between = np.sqrt(np.maximum(0, 2 - 2 * (x[pool] @ x[pool].T)))
            alive, kept = np.ones(len(pool), bool), []
            while len(kept) < DEGREE and alive.any():
                j = int(alive.argmax())
                kept.append(pool[j])
                alive &= ALPHA * between[j] > far
                alive[j] = False
            out.append(np.array(kept, np.int64))
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean, then ones farthest from those before."""
    found = [int((x @ x.mean(0)).argmax())]
    nearest = x @ x[found[0]]
    for _ in range(min(MEDOIDS, len(x)) - 1):
        found.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[found[-1]])
    return np.unique(found)


def searched(x: np.ndarray, adjacent: np.ndarray, starts: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float, slack: float = 0.02) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, cosine) of the pairs with a cosine >= least that the search finds, for a few queries at a time.

    adjacent: (vectors, degree), -1 where there is none; starts are where every query
    enters, own (queries, some) where each one enters besides.
    """
    n = len(x)
    step = max(1, min(256, (1 << 20) // max(1, n)))
    for low in range(0, len(queries), step):
        q, also = queries[low : low + step], own[low : low + step]
        like = np.full((len(q), n), -2.0)
        open_ = np.zeros((len(q), n), bool)

        def meet(r: np.ndarray, v: np.ndarray, q=q, like=like, open_=open_) -> None:
            fresh = like[r, v] < -1.5
            key = np.unique(r[fresh] * n + v[fresh])
            r, v = key // n, key % n
            for at in range(0, len(r), 1 << 13):
                rr, vv = r[at : at + (1 << 13)], v[at : at + (1 << 13)]
                like[rr, vv] = np.einsum("ij,ij->i", q[rr], x[vv])
            open_[r, v] = True

        def expand(rows: np.ndarray, nodes: np.ndarray, open_=open_, meet=meet) -> None:
            open_[rows, nodes] = False
            for at in range(0, len(rows), 1 << 12):
                to = adjacent[nodes[at : at + (1 << 12)]]
                use = to >= 0
                meet(np.repeat(rows[at : at + (1 << 12)], use.sum(1)), to[use])

        rows = np.arange(len(q))
        meet(np.repeat(rows, len(starts)), np.tile(starts, len(q)))
        use = also >= 0
        meet(np.repeat(rows, use.sum(1)), also[use])
        for _ in range(BEAM):
            ranked = np.where(open_, like, -3)
            nodes = ranked.argmax(1)
            use = ranked[rows, nodes] > -2.5
            if not use.any():
                break
            expand(rows[use], nodes[use])
        while True:
            r, v = np.nonzero(open_ & (like >= least - slack))
            if not len(r):
                break
            expand(r, v)
        r, v = np.nonzero(like >= least)
        yield r + low, v, like[r, v]


def range_search(x: np.ndarray, adjacent: np.ndarray, starts: np.ndarray, queries: np.ndarray, least: float, slack: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs found from the starts alone."""
    found = [(q, v) for q, v, _ in searched(x, adjacent, starts, queries, np.full((len(queries), 1), -1), least, slack)]
    return tuple(np.concatenate(k) for k in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place hangs together with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots after some more links."""
    apart = root[a] != root[b]
    pairs = np.unique(np.stack([root[a[apart]], root[b[apart]]], 1), axis=0)
    return _roots(len(root), pairs[:, 0], pairs[:, 1])[root] if len(pairs) else root


def _build(rows: pa.Table) -> pa.Table:
    """Graph of one shard: node, its neighbours' nodes."""
    nodes = rows["node"].to_numpy()
    kept = pruned(unit(rows["raw"].to_pylist()))
    return pa.Table.from_arrays([pa.array(nodes), pa.array([nodes[k].tolist() for k in kept], pa.list_(pa.int64()))], names=["node", "near"])


def _places(near: list, sorted_nodes: np.ndarray, most: int) -> np.ndarray:
    """(rows, most): where the first of the named nodes stand in sorted_nodes, -1 where there is none."""
    out = np.full((len(near), most), -1)
    if len(sorted_nodes):
        for i, own in enumerate(near):
            own = np.array(own or [], np.int64)
            at = np.minimum(np.searchsorted(sorted_nodes, own), len(sorted_nodes) - 1)
            at = np.unique(at[sorted_nodes[at] == own])[:most]
            out[i, : len(at)] = at
    return out


def _padded(rows: list) -> np.ndarray:
    out = np.full((len(rows), max([1, *map(len, rows)])), -1)
    for i, own in enumerate(rows):
        out[i, : len(own)] = own
    return out


def _owners(homes: list, visits: list, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kinds of queries, kinds of vectors): whether a pair counts in this shard, the first of the vector's shards that the query visits; and the kind of each query and vector."""
    home, home_kind = np.unique(_padded(homes), axis=0, return_inverse=True)
    visit, visit_kind = np.unique(_padded(visits), axis=0, return_inverse=True)
    mine = np.empty((len(visit), len(home)), bool)
    for i, own in enumerate(visit):
        seen = np.isin(home, own[own >= 0])
        mine[i] = np.where(seen.any(1), home[np.arange(len(home)), seen.argmax(1)], shard) == shard
    return mine, visit_kind.reshape(-1), home_kind.reshape(-1)


def _search(least: float):
    def run(rows: pa.Table) -> pa.Table:
        """Queries against the vectors of one shard block: node, links counted here, and the smallest node it hangs together with here."""
        role = rows["role"].to_numpy()
        nodes, weight = rows["node"].to_numpy(), rows["copies"].to_numpy()
        base, asks = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        order = base[np.argsort(nodes[base])]
        names, place = np.unique(nodes, return_inverse=True)
        counted, root = np.zeros(len(asks), np.int64), np.arange(len(names))
        if len(order) and len(asks):
            sorted_nodes, raws, near = nodes[order], rows["raw"].to_pylist(), rows["near"].to_pylist()
            vectors, queries = (unit([raws[i] for i in which.tolist()]) for which in (order, asks))
            adjacent = np.full((len(order), 3 * DEGREE), -1)
            adjacent[:, : 2 * DEGREE] = _places([near[i] for i in order.tolist()], sorted_nodes, 2 * DEGREE)
            back = [0] * len(order)
            for i, j in [(i, j) for i, own in enumerate(adjacent.tolist()) for j in own if j >= 0]:
                if back[j] < DEGREE:
                    adjacent[j, 2 * DEGREE + back[j]] = i
                    back[j] += 1
            own = _places([[*(near[i] or []), int(nodes[i])] for i in asks.tolist()], sorted_nodes, 2 * DEGREE + 1)
            mine, visit, home = _owners(rows["homes"].take(pa.array(order)).to_pylist(), rows["probes"].take(pa.array(asks)).to_pylist(), rows["shard"][0].as_py())
            for q, v, like in searched(vectors, adjacent, medoids(vectors), queries, own, least - 1e-9):
                # exactly, in double precision, on the vectors as they are
                good = nodes[asks[q]] != sorted_nodes[v]
                for k in np.flatnonzero(np.abs(like - least) < 1e-9).tolist():
                    a, b = (np.frombuffer(raws[i], "<f8") for i in (asks[q[k]], order[v[k]]))
                    good[k] &= a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least
                q, v = q[good], v[good]
                owned = mine[visit[q], home[v]]
                counted += np.bincount(q[owned], weight[order[v[owned]]], len(asks)).astype(np.int64)
                root = _merged(root, place[asks[q]], place[order[v]])
        return pa.Table.from_arrays([pa.array(nodes[asks]), pa.array(counted), pa.array(names[root[place[asks]]])], names=["node", "links", "root"])

    return run


def _centred(shard_rows: int):
    """The centres of one cluster, from a sample of it, packed."""

    def run(rows: pa.Table) -> pa.Table:
        n = -(-rows["size"][0].as_py() // (2 * shard_rows))
        order = np.argsort(rows["node"].to_numpy())
        found = centres(unit([rows["raw"][i].as_py() for i in order.tolist()]), n)
        return pa.Table.from_arrays([pa.array([rows["cluster"][0].as_py()], pa.int64()), pa.array([found.astype("<f8").tobytes()], pa.binary())], names=["cluster", "middle"])

    return run


def _divided(least: float, probes: int):
    """The shards within a cluster that each vector visits, the first of them its home if the cluster is."""

    def run(rows: pa.Table, middles: pa.Table) -> pa.Table:
        node, cluster, rank = (rows[k].to_numpy() for k in ("node", "cluster", "rank"))
        home = rows["home"].to_numpy(zero_copy_only=False)
        best = [np.zeros(1, np.int64)] * len(node)
        if middles.num_rows and len(node):
            x = unit(rows["raw"].to_pylist())
            best = visited(x, np.frombuffer(middles["middle"][0].as_py(), "<f8").reshape(-1, x.shape[1]), least, probes)
        n = np.array([len(b) for b in best], np.int64)
        at, k = np.repeat(np.arange(len(node)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        sub = np.concatenate([np.zeros(0, np.int64), *best])
        columns = [node[at], (cluster[at] << 20) + sub, (rank[at].astype(np.int64) << 20) + k, home[at] & (k == 0)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["node", "shard", "rank", "home"])

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, shard_rows: int = 2_000, sample: int = 8_192, clusters: int = 1_024, homes: int = 2, probes: int = 4) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    n_links counts the other rows with a cosine of at least `least`, copies included;
    component_id is the smallest id that links reach. Vectors that are null, empty, zero
    or hold null or non-finite numbers link with nothing, and vectors of different
    lengths do not link with each other. Repeated rows count as rows. A null id is never
    the smallest unless there is no other; component_id is then null and kept false. An
    empty table gives no rows. Other columns of df are not read.
    """
    spark = df.sparkSession
    rows = settle(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_classes, "vec_id long, node long, raw binary"))
    classes = settle(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")).withColumn("dim", F.expr("length(raw) div 8")))
    dims = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    middles: dict[int, np.ndarray] = {}
    for dim, n in dims.items():
        drawn = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))).select("node", "raw").collect()
        drawn = sorted(drawn, key=lambda r: r["node"])
        if drawn:
            middles[dim] = centres(unit([bytes(r["raw"]) for r in drawn]), max(1, min(clusters, math.ceil(n / (shard_rows / homes)))))
    shared = spark.sparkContext.broadcast(middles)

    def place(batches):
        for batch in batches:
            out = []
            for raw, dim in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                middle = shared.value.get(dim)
                best = [0] if middle is None else visited(unit([raw]), middle, least, probes)[0].tolist()
                out.append([(dim << 20) + c for c in best])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], names=["node", "raw", "clusters"])

    # within the clusters: parts of a cluster are dealt to tasks, each with the cluster's centres
    near = settle(classes.select("node", "raw", "dim").mapInArrow(place, "node long, raw binary, clusters array<long>").select("node", "raw", F.posexplode("clusters").alias("rank", "cluster")))
    near = near.withColumn("home", F.col("rank") < homes)
    sizes = near.where("home").groupBy("cluster").agg(F.count("*").alias("size"))
    large = settle(sizes.where(F.col("size") > 2 * shard_rows))
    drawn = near.where("home").join(large, "cluster").where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(sample)) / F.col("size")) * (1 << 30))
    own_centres = settle(drawn.select("cluster", "size", "node", "raw").groupBy("cluster").applyInArrow(_centred(shard_rows), "cluster long, middle binary"))
    parts = near.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(8.0 * shard_rows)).cast("int").alias("parts"))
    dealt = near.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")).select("cluster", "part", "node", "raw", "rank", "home")
    every = own_centres.join(parts, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "middle")
    shards = dealt.groupBy("cluster", "part").cogroup(every.groupBy("cluster", "part")).applyInArrow(_divided(least, 2), "node long, shard long, rank long, home boolean")
    lists = shards.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "shard", "home"))).alias("s"))
    placed = lists.select("node", F.expr("transform(filter(s, x -> x.home), x -> x.shard)").alias("homes"), F.expr("transform(s, x -> x.shard)").alias("probes"))
    placed = settle(placed.join(classes.select("node", "copies", "raw"), "node"))
    release(near, large, own_centres)

    blocks = placed.select(F.explode("homes").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / F.lit(2.0 * shard_rows)).cast("int").alias("blocks"))
    at_home = placed.select("*", F.explode("homes").alias("shard")).join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    graph = at_home.select("shard", "block", "node", "raw").groupBy("shard", "block").applyInArrow(_build, "node long, near array<long>")
    united = settle(placed.join(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "node"))
    sweep(spark)
    # the queries of a shard are dealt into parts of a bounded expected size, each with the shard's vectors
    asked = united.select("*", F.explode("probes").alias("shard"))
    deal = asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(8.0 * shard_rows)).cast("int").alias("parts")).join(blocks, "shard")
    base = united.select("*", F.explode("homes").alias("shard")).join(deal, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    asked = asked.join(deal, "shard").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    columns = ("shard", "block", "part", "role", "node", "copies", "raw", "homes", "probes", "near")
    both = base.withColumn("role", F.lit(0)).select(*columns).unionByName(asked.withColumn("role", F.lit(1)).select(*columns))
    found = settle(both.groupBy("shard", "block", "part").applyInArrow(_search(least), "node long, links long, root long"))
    release(placed, united)
    sweep(spark)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "rep", "copies").join(links, "node", "left").join(comps, "node", "left").select("node", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    out = rows.select("vec_id", "node").join(named.join(smallest, "comp").select("node", "n_links", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    done = settle(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")))
    release(rows, classes, found, comps)
    return done


def audit(df: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, queries: int = 200) -> float:
    """Share of true links that the result counts, over `queries` rows (those with the smallest hashes of their ids) against all rows."""
    valid = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_classes, "vec_id long, node long, raw binary").where("node is not null")
    chosen = valid.where("vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    if not chosen:
        return 1.0
    shared = df.sparkSession.sparkContext.broadcast([(r["vec_id"], bytes(r["raw"])) for r in chosen])

    def count(batches):
        asks = shared.value
        total = np.zeros(len(asks), np.int64)
        for batch in batches:
            raws = batch.column(0).to_pylist()
            for length in {len(r) for r in raws}:
                x = unit([r for r in raws if len(r) == length])
                for k, (_, raw) in enumerate(asks):
                    if len(raw) == length:
                        total[k] += int((x @ unit([raw])[0] >= least).sum())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in asks], pa.int64()), pa.array(total)], names=["vec_id", "n"])

    true = valid.select("raw").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    both = true.join(result.dropDuplicates(["vec_id"]), "vec_id").agg(F.sum(F.least("n", "n_links")).alias("found"), F.sum("n").alias("true")).first()
    return both["found"] / both["true"] if both["true"] else 1.0
