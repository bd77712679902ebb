"""Near-dedup of embeddings over a robust-pruned flat graph.

Vectors are scaled to unit length in double precision; equal ones become one node with a count. Centroids, fitted on a bounded sample, give
each node its ``overlap`` nearest clusters as shards; every node is indexed. A shard is cut into blocks of at most ``block`` nodes, and a
robust-pruned graph is built on each: of a node's nearest candidates those stay that no closer kept neighbour is ``alpha`` times nearer to.
A node's lists from all its shards are united. For each pair of an index block and a query block of a shard, greedy search from the block's
medoid, from the query itself and from those of its united list that lie in the block finds the query's surroundings, and the range is
expanded along the lists from every node near enough until nothing new is near. Blocks are cut anew in each shard, so that near nodes that
one shard parts meet in the lists of another.
Found pairs are verified by their cosine. A pair that several shards hold counts in the first of them. Tasks hold two blocks, whatever a
cluster's size, and emit a row a node, not the links.

The overlap starts where pairs of cosine ``least``, made from sampled rows, share a shard; it grows with the number of centroids. Recall is
audited on sampled nodes against all rows: nodes are drawn until ``linked`` of them have a link, all are drawn or ``most_audited`` are. It
is the lower of the share of their distinct linked pairs and the mean share of a node with links, so that a large group hides no small one;
below ``recall`` the overlap is doubled and the work repeated; once it covers all clusters, blocks are compared whole instead of searched,
which misses nothing. If no drawn node has a link, nothing was measured and audit_recall is null.

Null vectors, zero vectors and vectors with null or non-finite components link with nothing, and every such row is its own component;
vectors of different dimensions are never linked; copies are linked with each other; a null vec_id counts as a link but names no component
that has an id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import connected, discard, lean, reread, with_fields, written

COSINE = 0.9


def units(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, node, unit): node is a hash of the unit vector's bytes, null for vectors that link with nothing."""

    def run(batches):
        for b in batches:
            node, unit = [], []
            for v in b.column(1).to_pylist():
                x = None
                if v and None not in v:
                    x = np.array(v, float)
                    x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else None
                if x is None:
                    node.append(None)
                    unit.append(None)
                else:
                    raw = (x / np.sqrt(x @ x) + 0.0).astype("<f8").tobytes()
                    node.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    unit.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(unit, pa.binary())], names=["vec_id", "node", "unit"])

    return rows.select(rows[vec_id].cast("bigint"), rows[vector].cast("array<double>")).mapInArrow(lean(run), "vec_id bigint, node bigint, unit binary")


def matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a spread start."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def reach(x: np.ndarray, c: np.ndarray, least: float, part: float) -> int:
    """The overlap at which a share ``part`` of pairs of cosine ``least`` share a centroid; a pair is a row of ``x`` and the same moved towards another."""
    rng = np.random.default_rng(7)
    a, b = x, x[rng.permutation(len(x))]
    w = b - np.einsum("ij,ij->i", a, b)[:, None] * a
    norm = np.linalg.norm(w, axis=1)
    a, w = a[norm > 1e-9], w[norm > 1e-9] / norm[norm > 1e-9, None]
    if not len(a):
        return 1
    y = least * a + np.sqrt(1 - least * least) * w
    place = [np.argsort(np.argsort(-(v @ c.T), axis=1, kind="stable"), axis=1, kind="stable") for v in (a, y)]
    return int(np.quantile(np.maximum(*place).min(1) + 1, part, method="higher"))


def pruned(order: np.ndarray, near: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Robust prune of candidates in order of distance (``near`` holds their cosines)."""
    away, between = np.sqrt(np.maximum(2 - 2 * near, 0)), np.sqrt(np.maximum(2 - 2 * (x[order] @ x[order].T), 0))
    open_, kept = np.ones(len(order), bool), []
    for k in range(len(order)):
        if open_[k]:
            kept.append(int(order[k]))
            if len(kept) == degree:
                break
            open_ &= alpha * between[k] > away
    return kept


def build(x: np.ndarray, degree: int = 24, pool: int = 48, alpha: float = 1.2) -> list[list[int]]:
    """Adjacency lists of a robust-pruned graph on the rows of ``x``, all of them reachable from the medoid."""
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    pool = min(pool, n - 1)
    lists: list[list[int]] = []
    if pool < 1:
        return [[] for _ in range(n)]
    top = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
    for i in range(n):
        order = top[i][np.argsort(-sims[i, top[i]], kind="stable")]
        lists.append(pruned(order, sims[i, order], x, degree, alpha))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, near in enumerate(lists):
        for j in near:
            back[j].append(i)
    for i in range(n):
        both = np.array(sorted({*lists[i], *back[i]}), np.int64)
        if len(both) > degree:
            order = both[np.argsort(-sims[i, both], kind="stable")]
            lists[i] = pruned(order, sims[i, order], x, degree, alpha)
        else:
            lists[i] = both.tolist()
    seen = np.zeros(n, bool)
    stack = [medoid(x)]
    seen[stack[0]] = True
    while True:
        while stack:
            for j in lists[stack.pop()]:
                if not seen[j]:
                    seen[j] = True
                    stack.append(j)
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return lists
        reached = np.flatnonzero(seen)
        part = sims[np.ix_(lost, reached)]
        i, j = np.unravel_index(part.argmax(), part.shape)
        lists[reached[j]].append(int(lost[i]))
        seen[lost[i]] = True
        stack = [int(lost[i])]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def search(x: np.ndarray, lists: list[list[int]], q: np.ndarray, least: float, starts: list[list[int]] | None = None, beam: int = 24, slack: float = 0.12):
    """(query, row, cosine) of the rows that greedy search from the medoid and from the query's ``starts``, and range expansion, find with cosine >= ``least``."""
    n, width = len(x), max(1, max(map(len, lists), default=1))
    table = np.full((n, width), -1, np.int64)
    for i, near in enumerate(lists):
        table[i, : len(near)] = near
    found = []
    for low in range(0, len(q), 512):
        part = q[low : low + 512]
        m = len(part)
        sim = np.full((m, n), np.nan)
        start = medoid(x)
        sim[:, start] = part @ x[start]
        expanded = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1, np.int64)
        ids[:, 0] = start
        for i, some in enumerate(starts[low : low + 512] if starts else ()):
            if some:
                near = np.unique([start, *some])
                sim[i, near] = x[near] @ part[i]
                near = near[np.argsort(-sim[i, near], kind="stable")][:beam]
                ids[i, : len(near)] = near
        while True:  # each query expands the nearest node of its beam that it hasn't expanded
            rows = np.arange(m)[:, None]
            value = np.where((ids >= 0) & ~expanded[rows, ids], sim[rows, ids], -9)
            pick = value.argmax(1)
            go = np.flatnonzero(value[np.arange(m), pick] > -9)
            if not len(go):
                break
            node = ids[go, pick[go]]
            expanded[go, node] = True
            new = table[node]
            r = np.repeat(go, width)
            c = new.ravel()
            ok = (c >= 0) & np.isnan(sim[r, c])
            r, c = r[ok], c[ok]
            sim[r, c] = np.einsum("ij,ij->i", part[r], x[c])
            pool = np.concatenate([ids[go], np.where(ok.reshape(len(go), width), new, -1)], 1)
            order = np.argsort(-np.where(pool >= 0, sim[go[:, None], pool], -9), axis=1, kind="stable")[:, :beam]
            ids[go] = np.take_along_axis(pool, order, 1)
        r, c = np.nonzero(np.nan_to_num(sim, nan=-9) >= least - slack)
        while len(r):  # the range grows along the lists
            new = ~expanded[r, c]
            r, c = r[new], c[new]
            expanded[r, c] = True
            near = table[c]
            rr, cc = np.repeat(r, width), near.ravel()
            ok = (cc >= 0) & np.isnan(sim[rr, np.maximum(cc, 0)])
            key = np.unique(rr[ok] * n + cc[ok])
            rr, cc = key // n, key % n
            sim[rr, cc] = np.einsum("ij,ij->i", part[rr], x[cc])
            close = sim[rr, cc] >= least - slack
            r, c = rr[close], cc[close]
        r, c = np.nonzero(np.nan_to_num(sim, nan=-9) >= least)
        found.append((r + low, c, sim[r, c]))
    return tuple(np.concatenate(a) for a in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def compare(x: np.ndarray, q: np.ndarray, least: float):
    """(query, row, cosine) of all pairs with cosine >= ``least``."""
    sim = q @ x.T
    r, c = np.nonzero(sim >= least)
    return r, c, np.einsum("ij,ij->i", q[r], x[c])


def _sharded(nodes: DataFrame, by_dim: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """``nodes`` with the array of their shards."""
    offset, at = {}, 0
    for d, c in sorted(by_dim.items()):
        offset[d] = at
        at += len(c)
    shared = nodes.sparkSession.sparkContext.broadcast((by_dim, offset))  # at most ``most_shards`` centroids a dimension

    def run(batches):
        of, off = shared.value
        for b in batches:
            raw = b.column(b.schema.get_field_index("unit")).to_pylist()
            out: list = [None] * len(raw)
            for d in {len(r) // 8 for r in raw}:
                mine = [i for i, r in enumerate(raw) if len(r) // 8 == d]
                near = np.argsort(-(matrix([raw[i] for i in mine]) @ of[d].T), axis=1, kind="stable")[:, :overlap]
                for i, row in zip(mine, near, strict=True):
                    out[i] = sorted((row + off[d]).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "shards"])

    return nodes.mapInArrow(lean(run), with_fields(nodes.schema, "shards array<int>"))


def _graphs(index: DataFrame) -> DataFrame:
    """(node, near): each node's united lists."""

    def run(table: pa.Table) -> pa.Table:
        nodes = np.array(table["node"])
        lists = build(matrix(table["unit"].to_pylist()))
        return pa.table({"node": nodes, "near": pa.array([nodes[a].tolist() for a in lists], pa.list_(pa.int64()))})

    lists = index.groupBy("shard", "iblock").applyInArrow(run, "node bigint, near array<bigint>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _linked(index: DataFrame, queries: DataFrame, least: float, whole: bool = False) -> DataFrame:
    """(node, links, pairs, root): in each pair of blocks, how many rows and nodes a query is linked to, and a node that it is connected to.

    The queries of a block in itself are its own rows and are not listed again. ``whole`` compares all of a block with all of the other instead of searching it.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"node": [], "links": [], "pairs": [], "root": []}
        if len(a):
            b = b if len(b) else a
            x, q = matrix(a["unit"].to_pylist()), matrix(b["unit"].to_pylist())
            xn, qn, weight, shard = np.array(a["node"]), np.array(b["node"]), np.array(a["n"]), a["shard"][0].as_py()
            place = {v: i for i, v in enumerate(xn.tolist())}
            lists = [[place[v] for v in near if v in place] for near in a["near"].to_pylist()]
            starts = [[place[v] for v in (k, *near) if v in place] for k, near in zip(qn.tolist(), b["near"].to_pylist(), strict=True)]
            r, c, sim = compare(x, q, least - 1e-9) if whole else search(x, lists, q, least - 1e-9, starts)
            good = (sim >= least) & (qn[r] != xn[c])
            r, c = r[good], c[good]
            xs, qs = [set(s) for s in a["shards"].to_pylist()], [set(s) for s in b["shards"].to_pylist()]
            first = np.array([min(xs[j] & qs[i]) == shard for i, j in zip(r.tolist(), c.tolist(), strict=True)], bool)
            links = np.bincount(r[first], weight[c[first]], len(qn)).astype(np.int64)
            pairs = np.bincount(r[first], minlength=len(qn))
            parent: dict[int, int] = {}

            def root(v):
                while parent.setdefault(v, v) != v:
                    parent[v] = v = parent[parent[v]]
                return v

            for i, j in zip(qn[r].tolist(), xn[c].tolist(), strict=True):
                u, v = root(i), root(j)
                if u != v:
                    parent[max(u, v)] = min(u, v)
            mine = {int(v): (int(n), int(m)) for v, n, m in zip(qn, links, pairs, strict=True)}
            for v in sorted({*parent, *(k for k, (n, _) in mine.items() if n)}):
                out["node"].append(v)
                out["links"].append(mine.get(v, (0, 0))[0])
                out["pairs"].append(mine.get(v, (0, 0))[1])
                out["root"].append(root(v))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    keys = ("shard", "iblock", "qblock")
    return index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "node bigint, links bigint, pairs bigint, root bigint")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = COSINE, overlap: int = 3, block: int = 3000, most_shards: int = 4096, sample: int = 20_000, audited: int = 256, linked: int = 500, most_audited: int = 16_384, recall: float = 0.99) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept, audit_recall."""
    all_ = written(units(rows, vec_id, vector), "units")
    nodes = all_.filter("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.first("unit").alias("unit"))
    nodes = written(nodes, "nodes")
    dims = {r.d: r.n for r in nodes.groupBy((F.length("unit") / 8).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()}
    total = sum(dims.values())
    samples, links, parts, measured = {}, None, None, None
    for d, n in dims.items():
        share = min(1.0, 1.2 * sample / n)
        drawn = nodes.filter((F.length("unit") == 8 * d) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
        some = drawn.orderBy(F.xxhash64("node", F.lit(3)), "node").select("unit").limit(sample).collect()  # in no relation to the audit's draws
        samples[d] = matrix([bytes(r.unit) for r in some]) if some else np.eye(1, d)
    held = {d: x[: min(2000, len(x) // 4)] for d, x in samples.items()}  # centroids lie nearer to pairs of the rows they were fitted on
    while True:
        by_dim = {d: centroids(x[len(held[d]) :], min(most_shards, max(1, -(-dims[d] * overlap // block)))) for d, x in samples.items()}
        least_overlap = max((reach(held[d] if len(held[d]) else x, by_dim[d], least, 1 - (1 - recall) / 10) for d, x in samples.items()), default=1)
        if least_overlap <= overlap:
            break
        overlap = least_overlap
    truth = _audit(nodes, least, audited, linked, most_audited) if total else {}
    whole = False
    while total:
        sharded = written(_sharded(nodes, by_dim, overlap), "sharded")
        sized = sharded.withColumn("shard", F.explode("shards"))
        blocks = sized.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        sized = sized.join(blocks, "shard").withColumn("own", F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int"))
        sized = written(sized, "blocks")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        lists = _graphs(sized.withColumnRenamed("own", "iblock").select("shard", "iblock", "node", "unit"))
        lists = written(lists, "lists")
        index = sized.join(lists, "node").withColumnRenamed("own", "iblock").withColumn("qblock", F.explode(every))
        queries = reread(sized).filter("blocks > 1").join(reread(lists), "node").withColumnRenamed("own", "qblock").withColumn("iblock", F.explode(every)).filter("iblock <> qblock")
        found = _linked(index.select("shard", "iblock", "qblock", "node", "unit", "n", "shards", "near"), queries.select("shard", "iblock", "qblock", "node", "unit", "shards", "near"), least, whole)
        found = written(found, "linked")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        got = {r.node: r.pairs for r in found.filter(F.col("node").isin(list(truth))).groupBy("node").agg(F.sum("pairs").alias("pairs")).collect()}
        met = {k: min(got.get(k, 0), want) for k, want in truth.items()}
        measured = min(sum(met.values()) / sum(truth.values()), sum(met[k] / truth[k] for k in truth) / len(truth)) if truth else None
        for t in (sharded, sized, lists):
            discard(t)
        if measured is None or measured >= recall or whole:
            parts = written(connected(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "parts")
            break
        whole = all(overlap >= len(c) for c in by_dim.values())
        overlap *= 2
    spark = rows.sparkSession
    if links is None:
        links = spark.createDataFrame([], "node bigint, links bigint")
        parts = spark.createDataFrame([], "node bigint, root bigint")
    counts = all_.filter("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    counts = counts.join(links, "node", "left").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = counts.groupBy("root").agg(F.min("low").alias("component_id"))
    counts = counts.join(lowest, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), "component_id")
    out = all_.select("vec_id", "node").join(counts, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(measured).cast("double").alias("audit_recall"))


def _audit(nodes: DataFrame, least: float, audited: int, linked: int, most: int) -> dict[int, int]:
    """Nodes with links, drawn by hash, and how many other nodes have cosine >= ``least`` with each. Draws grow until ``linked`` are found."""
    truth: dict[int, int] = {}
    drawn, size = 0, min(audited, most)
    while True:
        probes = [(r.node, bytes(r.unit)) for r in nodes.orderBy(F.xxhash64("node"), "node").select("node", "unit").limit(size).collect()]
        if len(probes) > drawn:
            truth |= {k: n for k, n in _brute(nodes, probes[drawn:], least).items() if n}
        if len(truth) >= linked or len(probes) < size or size >= most:
            return truth
        drawn, size = size, min(4 * size, most)


def _brute(nodes: DataFrame, probes: list[tuple[int, bytes]], least: float) -> dict[int, int]:
    """For each probe, how many other nodes have cosine >= ``least`` with it: a pass over all nodes."""
    shared = nodes.sparkSession.sparkContext.broadcast(probes)  # at most ``most_audited``

    def run(batches):
        by_dim: dict[int, list] = {}
        for k, u in shared.value:
            by_dim.setdefault(len(u) // 8, []).append((k, u))
        asked = {d: (np.array([k for k, _ in some]), matrix([u for _, u in some])) for d, some in by_dim.items()}
        for b in batches:
            raw, ids = b.column(1).to_pylist(), np.array(b.column(0))
            for d, (keys, q) in asked.items():
                mine = [i for i, r in enumerate(raw) if len(r) // 8 == d]
                x = matrix([raw[i] for i in mine]).T if mine else None
                for low in range(0, len(keys) if mine else 0, 1024):
                    k = keys[low : low + 1024]
                    hit = q[low : low + 1024] @ x >= least
                    hit &= k[:, None] != ids[mine]
                    n = hit.sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(k[n > 0], pa.int64()), pa.array(n[n > 0].astype(np.int64))], names=["node", "links"])

    return {r.node: r.links for r in nodes.select("node", "unit").mapInArrow(lean(run), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links")).collect()}
