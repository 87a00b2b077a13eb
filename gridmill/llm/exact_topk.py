"""Exact top-k search of every row among all rows: M-trees searched best first.

The metric space is cut into nodes around routers (a hash-ordered sample of the rows), and nodes of more than
``page_rows`` rows into pages around routers of their own, sampled from the node's rows. Each page is an M-tree: inner
entries hold a router, its covering radius and its distance to the page's router; leaf entries hold their distance to
their own router. All queries that meet in a page go through its tree together, each in its own best-first order: a
query leaves a subtree unopened when its lower bound exceeds the query's k-th distance, and skips the distance to an
entry when the stored distances already rule it out (``|d(q, parent) - d(entry, parent)| - radius`` beyond the k-th
distance).

A query first searches its own page, which bounds its k-th distance; it then goes down from the nodes in the same way,
by covering radii and parent distances, and only to pages that may hold something within the bound. Pages lie in
bundles; a query is sent once to a bundle in which it has a page to visit, takes what it found in one page as its bound
in the next, and a bundle is sent once for so many queries as it has rows. The results are exact. All routers are
broadcast, ``max_routers`` nodes and as many pages as ``limit_bytes`` hold; where that is too few, or rows are equal, a
page is cut further by a hash of the row, and the parts are all visited.

Distances are Euclidean. Defined results: rows with a null id, a null or empty vector, a null or NaN element, or
another length than most rows are left out; a row is no neighbour of its own id; rows of one id are one query, which
keeps the nearest to any of them; ties go to the smaller id; a table with fewer than k others gives what there is;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm import kernels as K

_NARROW = 1e15  #: lengths up to which squares are taken in single precision


def _slack(scale, dims: int):
    """What a distance from a product of matrices may be off by, for vectors of that length."""
    return 1e-9 + np.sqrt((dims + 16) * 2.0**-52) * scale


class Tree:
    """Two levels of metric nodes over the rows of a page, all around the page's router.

    Vectors are held relative to that router. Products of matrices, in single precision where no square can overflow it,
    only leave out what is too far by more than their error; what they leave is measured exactly.
    ``first`` is the number of the first row and ``total`` that of all rows, where there are several trees.
    """

    def __init__(self, vectors: np.ndarray, router: np.ndarray, fan: int = 256, first: int = 0, total: int | None = None):
        n = len(vectors)
        m = max(1, min(n, int(np.ceil(n / fan))))
        self.router, self.vectors, self.first, self.total = router, vectors, first, n if total is None else total
        x = vectors - router
        square = (x**2).sum(1)
        self.routers = x[np.linspace(0, n - 1, m).astype(int)]
        self.parent = np.sqrt((self.routers**2).sum(1))  # of inner entries, to the page's router
        near = np.argmin(self.parent**2 - 2 * x @ self.routers.T, 1)
        leaf = np.sqrt(((x - self.routers[near]) ** 2).sum(1))
        by = np.lexsort((leaf, near))  # the entries of a leaf by their distance to its router
        self.members = np.split(by, np.searchsorted(near[by], np.arange(1, m)))
        self.leaf = [leaf[y] for y in self.members]
        self.radius = np.array([y[-1] if len(y) else -np.inf for y in self.leaf])
        self.norm = np.sqrt(np.array([square[y].max() if len(y) else 0 for y in self.members]))
        self.wide = np.concatenate([x, square[:, None], np.ones((n, 1))], 1)
        self.narrow = [self.wide[y].astype(np.float32) for y in self.members] if self.norm.max() < _NARROW else None
        self.computed = self.spared = 0

    def search(self, queries: np.ndarray, to_router: np.ndarray, bound: np.ndarray, rank: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray] | None = None):
        """For each query the row numbers and distances of its k nearest within its bound, also among those ``found`` in other trees.

        ``rank`` orders the ids of the rows and, after them, of the queries; a row of a query's own id is left out.
        """
        q, dims = queries.shape
        rows, dist = found or (np.full((q, k), -1), np.full((q, k), np.inf))
        kth = np.minimum(bound, dist[:, k - 1])
        x = queries - self.router
        square = (x**2).sum(1)
        norm = np.sqrt(square)
        slack = _slack(norm + self.norm.max(), dims)
        narrow = self.narrow is not None and not (norm >= _NARROW).any()
        ask = np.concatenate([-2 * x, np.ones((q, 1)), square[:, None]], 1).astype(np.float32 if narrow else np.float64)
        may = ~(np.abs(to_router[:, None] - self.parent) - self.radius > (kth + slack)[:, None])
        at_router = np.full(may.shape, np.inf)
        a, c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        at_router[np.ix_(a, c)] = np.sqrt(np.maximum(square[a][:, None] + self.parent[c] ** 2 - 2 * x[a] @ self.routers[c].T, 0))
        self.computed += len(a) * len(c)
        self.spared += may.size - len(a) * len(c)
        lower = np.where(may, np.fmax(at_router - self.radius, 0), np.inf)
        new: list[tuple] = []  # what was found and isn't kept yet
        while True:
            node = np.argmin(lower, 1)
            best = lower[np.arange(q), node]
            live = np.flatnonzero(np.isfinite(best) & (best <= kth + slack))
            if not len(live):
                self._keep(new, rows, dist, kth, rank, k)
                return rows, dist
            lower[live, node[live]] = np.inf
            live = live[np.argsort(node[live], kind="stable")]
            for i in np.split(live, np.flatnonzero(np.diff(node[live])) + 1):
                c = node[i[0]]
                for s in range(0, len(i), 512):
                    if (some := self._visit(c, i[s : s + 512], queries, ask, norm, at_router[i[s : s + 512], c], slack, kth, rank, k)) is not None:
                        new.append(some)
                        if sum(len(y[0]) for y in new) > 2 * q:
                            self._keep(new, rows, dist, kth, rank, k)

    def _visit(self, c, i, queries, ask, norm, at, slack, kth, rank, k) -> tuple | None:
        """The entries of a leaf within the k-th distance of the queries that open it, of those that the stored distances don't rule out."""
        leaf, reach = self.leaf[c], kth[i] + slack[i]
        lo, hi = np.searchsorted(leaf, at - reach), np.searchsorted(leaf, at + reach, "right")
        some = hi > lo
        if not some.any():
            self.spared += len(i) * len(leaf)
            return None
        all_, i, lo, hi = len(i), i[some], lo[some].min(), hi[some].max()
        self.computed += len(i) * (hi - lo)
        self.spared += all_ * len(leaf) - len(i) * (hi - lo)
        own = self.members[c][lo:hi]
        rough = ask[i] @ (self.narrow[c][lo:hi] if ask.dtype == np.float32 else self.wide[own]).T
        error = (ask.shape[1] + 16) * np.finfo(ask.dtype).eps * (norm[i] + self.norm[c]) ** 2 + (1e-30 if ask.dtype == np.float32 else 1e-300)
        limit = np.minimum(kth[i], 1e150) ** 2 + error
        free = np.flatnonzero(np.isinf(kth[i]))
        if len(free) and hi - lo >= k:  # the k-th of these rows is a bound
            others = np.where(rank[self.first + own] == rank[self.total + i[free]][:, None], np.inf, rough[free])
            limit[free] = np.minimum(limit[free], np.partition(others, k - 1, 1)[:, k - 1] + 2 * error[free])
        with np.errstate(over="ignore"):
            limit = (limit * (1 + 1e-6)).astype(ask.dtype)
        near = np.zeros((len(i), -(-(hi - lo) // 8) * 8), bool)  # eight of them are looked through at once
        np.logical_not(rough > limit[:, None], out=near[:, : hi - lo])
        eight = np.flatnonzero(near.reshape(-1).view(np.uint64))
        a, b = np.nonzero(near.reshape(-1, 8)[eight])
        a, b = np.divmod(eight[a] * 8 + b, near.shape[1])
        a, own = i[a], own[b]
        keep = rank[self.first + own] != rank[self.total + a]
        a, own = a[keep], own[keep]
        d = np.concatenate([np.zeros(0), *(np.sqrt(((queries[a[s : s + 65536]] - self.vectors[own[s : s + 65536]]) ** 2).sum(1)) for s in range(0, len(a), 65536))])
        fits = d <= kth[a]
        return (a[fits], self.first + own[fits], d[fits]) if fits.any() else None

    @staticmethod
    def _keep(new, rows, dist, kth, rank, k) -> None:
        """Puts what is new, rows at their distances to queries, among the k nearest of these."""
        if not new:
            return
        a, own, d = (np.concatenate(y) for y in zip(*new))
        new.clear()
        by = np.argsort(a, kind="stable")
        hit, first, many = np.unique(a[by], return_index=True, return_counts=True)
        place = np.arange(len(a)) - np.repeat(first, many)
        if many.max() > 64:  # only the k nearest of each can matter
            by = np.lexsort((rank[own], d, a))
            by, place = by[place < k], place[place < k]
        own, d, line = own[by], d[by], np.searchsorted(hit, a[by])
        who, far = np.full((len(hit), k + place.max() + 1), -1), np.full((len(hit), k + place.max() + 1), np.inf)
        who[:, :k], far[:, :k] = rows[hit], dist[hit]
        who[line, k + place], far[line, k + place] = own, d
        take = np.lexsort((np.where(who >= 0, rank[who], 2**62), far), axis=1)[:, :k]
        rows[hit], dist[hit] = np.take_along_axis(who, take, 1), np.take_along_axis(far, take, 1)
        kth[hit] = np.minimum(kth[hit], dist[hit, k - 1])


def nearest(vectors: DataFrame, k: int = 10, page_rows: int = 8192, max_routers: int = 2048, limit_bytes: int = 64 << 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, rank, neighbor, distance)``: the k nearest others of every row, rank from 1."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    real = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast(real)).alias("v"))
    v = v.filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, rank int, neighbor {kind}, distance double")
    n, dims = sizes["count"], sizes["d"]
    v = v.filter(F.size("v") == dims).distinct()
    most = max(1, limit_bytes // (8 * dims))
    m = int(max(1, min(max_routers, n // (page_rows // 2), most)))
    hashed = F.xxhash64(F.col("id").cast("string"))
    nodes = v.orderBy(hashed, "id", "v").limit(m).toPandas()["v"]
    nodes = np.unique(np.stack([np.asarray(x, float) for x in nodes]), axis=0)

    kind_of = np.dtype(np.float32 if real == "float" else np.float64)

    def packed(x: np.ndarray) -> pa.Array:
        """The rows of a matrix as bytes, in the type in which they were read."""
        x = np.ascontiguousarray(x, kind_of)
        ends = np.arange(len(x) + 1, dtype=np.int64) * (dims * kind_of.itemsize)
        assert ends[-1] < 2**31
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)])

    def matrix(column) -> np.ndarray:
        parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
        out = [np.zeros((0, dims))]
        for part in parts:
            if len(part):
                at = np.frombuffer(part.buffers()[1], np.int32)[part.offset]
                out.append(np.frombuffer(part.buffers()[2], kind_of, len(part) * dims, at).reshape(-1, dims).astype(float))
        return np.concatenate(out)

    def closest(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.argmin((x**2).sum(1)[:, None] - 2 * x @ r.T + (r**2).sum(1), 1)
        return at, np.sqrt(((x - r[at]) ** 2).sum(1))

    top = spark.sparkContext.broadcast(nodes)

    def assign(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float)
            node, d = closest(x, top.value)
            yield pa.record_batch([batch.column(0), packed(x), pa.array(node, pa.int32()), pa.array(d)], ["id", "v", "node", "nd"])

    rows = K.settle(v.mapInArrow(assign, f"id {kind}, v binary, node int, nd double"))
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.max("nd").alias("r")).toPandas().sort_values("node")  # a row a node
    used, count = sizes["node"].to_numpy(), sizes["n"].to_numpy()
    wanted = np.where(count > page_rows, -(-count // max(1, page_rows // 2)), 1)
    wanted = np.maximum(1, (wanted * min(1.0, most / wanted.sum())).astype(int))
    big = {int(c): int(w) for c, w in zip(used, wanted) if w > 1}
    own = {int(c): nodes[[c]] for c in used}  # the routers of each node's pages
    if big:
        share = F.create_map(*[F.lit(x) for pair in big.items() for x in pair])
        some = rows.filter(F.col("node").isin(list(big))).withColumn("w", F.row_number().over(Window.partitionBy("node").orderBy(hashed, "id", "v"))).filter(F.col("w") <= F.element_at(share, F.col("node")))
        for c, part in some.select("node", "v").toPandas().groupby("node"):
            own[int(c)] = np.unique(np.stack([np.frombuffer(x, kind_of).astype(float) for x in part["v"]]), axis=0)
    first = np.cumsum([0] + [len(own[int(c)]) for c in used])
    routers = np.concatenate([own[int(c)] for c in used])
    parent = np.repeat(np.arange(len(used)), np.diff(first))  # of pages, the place of the node among those used
    aside = np.sqrt(((routers - nodes[used[parent]]) ** 2).sum(1))  # and the distance to its router
    top.unpersist()
    held = spark.sparkContext.broadcast((nodes[used], sizes["r"].to_numpy(), routers, first, aside))
    where = {int(c): i for i, c in enumerate(used)}

    def page(batches):
        routers, first = held.value[2:4]
        for batch in batches:
            x, node = matrix(batch.column(1)), batch.column(2).to_numpy()
            at, d = np.empty(len(x), np.int32), batch.column(3).to_numpy().copy()
            for c in np.unique(node):
                i, k = np.flatnonzero(node == c), where[int(c)]
                at[i] = first[k]
                if first[k + 1] - first[k] > 1:
                    near, d[i] = closest(x[i], routers[first[k] : first[k + 1]])
                    at[i] += near
            yield pa.record_batch([*batch.columns[:2], pa.array(at, pa.int32()), pa.array(d)], ["id", "v", "page", "pd"])

    rows = K.settle(rows.mapInArrow(page, f"id {kind}, v binary, page int, pd double"), over=rows)
    pages = rows.groupBy("page").agg(F.count("*").alias("n"), F.max("pd").alias("r")).toPandas()  # a row a page
    radius, subs = np.full(len(routers), -np.inf), np.zeros(len(routers), int)
    radius[pages["page"]] = pages["r"]
    subs[pages["page"]] = -(-pages["n"].to_numpy() // page_rows)
    cut = {int(p): int(c) for p, c in enumerate(subs) if c > 1}
    cuts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), F.col("page")), F.lit(1)) if cut else F.lit(1)
    of = np.repeat(np.arange(len(routers)), subs)  # the pages of parts, which lie in bundles of about tile rows
    sizes = np.zeros(len(routers))
    sizes[pages["page"]] = pages["n"]
    sizes = sizes[of] / subs[of]
    tile = max(1, min(max(page_rows, n // 4), (32 << 20) // (8 * dims)))
    bundle = np.unique((np.cumsum(sizes) - sizes) // tile, return_inverse=True)[1]
    begin = np.cumsum(subs) - subs
    plan = spark.createDataFrame(pa.table({"page": pa.array(of, pa.int32()), "sub": pa.array(np.arange(len(of)) - begin[of], pa.int32()), "unit": pa.array(np.arange(len(of)), pa.int32()), "bundle": pa.array(bundle, pa.int32())}))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("id", "v"), cuts).cast("int")).join(F.broadcast(plan), ["page", "sub"]).select("id", "v", "pd", "unit", "bundle")
    laid = spark.sparkContext.broadcast((radius, subs, begin, of, bundle))

    def ranks(a: pa.Array, b: pa.Array) -> np.ndarray:
        """Numbers that order the ids of both as the ids are ordered."""
        return np.unique(pa.concat_arrays([a, b]).to_numpy(zero_copy_only=False), return_inverse=True)[1]

    def home(table: pa.Table) -> pa.Table:
        x, ids = matrix(table["v"]), table["id"].combine_chunks()
        page = laid.value[3][table["unit"][0].as_py()]
        at, dist = Tree(x, held.value[2][page]).search(x, table["pd"].to_numpy(), np.full(len(x), np.inf), ranks(ids, ids), k)
        fits = np.isfinite(dist)
        near = pa.StructArray.from_arrays([ids.take(pa.array(at[fits])), pa.array(dist[fits])], ["neighbor", "d"])
        near = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *fits.sum(1)]), pa.int32()), near)
        return pa.table([ids, table["v"], table["unit"], pa.array(dist[:, k - 1]), near], ["id", "v", "unit", "bound", "near"])

    bounded = K.settle(rows.groupBy("unit").applyInArrow(home, f"id {kind}, v binary, unit int, bound double, near array<struct<neighbor: {kind}, d: double>>"))

    def route(batches):
        """Rows of each batch and the bundles with a part, but their own, that may hold something within their bounds."""
        nodes, reach, routers, first, aside = held.value
        radius, subs, begin, _, bundle = laid.value
        longest = np.sqrt(max((nodes**2).sum(1).max(), (routers**2).sum(1).max()))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x, own, bound = matrix(part.column(1)), part.column(2).to_numpy(), part.column(3).to_numpy()
                square = (x**2).sum(1)
                bound = bound + 1e-6 + 2 * _slack(np.sqrt(square) + longest, dims)
                d = np.sqrt(np.maximum(square[:, None] - 2 * x @ nodes.T + (nodes**2).sum(1), 0))
                open_ = d - reach[None, :] <= bound[:, None]
                pairs = [np.zeros(0, int)]
                for c in np.flatnonzero(open_.any(0)):
                    q, kids = np.flatnonzero(open_[:, c]), np.arange(first[c], first[c + 1])
                    a, b = np.nonzero(np.abs(d[q, c][:, None] - aside[kids][None, :]) - radius[kids][None, :] <= bound[q][:, None])
                    for s in range(0, len(a), 8192):
                        rows_, pages_ = q[a[s : s + 8192]], kids[b[s : s + 8192]]
                        may = np.sqrt(((x[rows_] - routers[pages_]) ** 2).sum(1)) - radius[pages_] <= bound[rows_]
                        rows_, pages_ = rows_[may], pages_[may]
                        n = subs[pages_]  # a page that is cut is visited in all its parts
                        unit = np.repeat(begin[pages_] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        rows_ = np.repeat(rows_, n)
                        other = unit != own[rows_]
                        pairs.append(np.unique(rows_[other] * (bundle[-1] + 1) + bundle[unit[other]]))
                yield part, *np.divmod(np.unique(np.concatenate(pairs)), bundle[-1] + 1)

    def tally(batches):
        asked = np.zeros(laid.value[4][-1] + 1, int)
        for _, _, b in route(batches):
            asked += np.bincount(b, minlength=len(asked))
        at = np.flatnonzero(asked)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(asked[at])], ["bundle", "n"])

    shares = np.zeros(bundle[-1] + 1, int)  # how often a bundle is sent, each time for other queries
    for r in bounded.mapInArrow(tally, "bundle int, n long").groupBy("bundle").agg(F.sum("n").alias("n")).collect():  # a row a bundle
        shares[r.bundle] = -(-r.n // tile)

    def ask(batches):
        for part, q, b in route(batches):
            at = pa.array(q)
            share = part.column(4).to_numpy()[q] % shares[b]
            yield pa.record_batch([*(part.column(c).take(at) for c in range(4)), pa.array(b, pa.int32()), pa.array(share, pa.int32())], ["id", "v", "unit", "bound", "bundle", "share"])

    asked = bounded.select("id", "v", "unit", "bound", F.pmod(F.xxhash64("id"), F.lit(2**31 - 1)).alias("h")).mapInArrow(ask, f"id {kind}, v binary, unit int, bound double, bundle int, share int")
    sent = spark.createDataFrame(pa.table({"bundle": pa.array(np.repeat(np.arange(len(shares)), shares), pa.int32()), "share": pa.array(np.arange(shares.sum()) - np.repeat(np.cumsum(shares) - shares, shares), pa.int32())}))

    def visit(queries: pa.Table, data: pa.Table) -> pa.Table:
        out = [pa.table({"id": pa.array([], data.schema.field("id").type), "neighbor": pa.array([], data.schema.field("id").type), "d": pa.array([], pa.float64())})]
        if not queries.num_rows or not data.num_rows:
            return out[0]
        data = data.sort_by("unit")
        x, ids, who = matrix(data["v"]), data["id"].combine_chunks(), queries["id"].combine_chunks()
        units, start = np.unique(data["unit"].to_numpy(), return_index=True)
        trees = [Tree(x[a:b], held.value[2][laid.value[3][u]], first=a, total=len(x)) for u, a, b in zip(units, start, [*start[1:], len(x)])]
        rank, y, own, bound = ranks(ids, who), matrix(queries["v"]), queries["unit"].to_numpy(), queries["bound"].to_numpy()
        for lo in range(0, len(y), 8192):
            q = np.arange(lo, min(lo + 8192, len(y)))
            at, dist = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
            for u, tree in zip(units, trees):
                d = np.sqrt(((y[q] - tree.router) ** 2).sum(1))
                reach = np.minimum(bound[q], dist[:, k - 1]) + _slack(d + tree.norm.max(), dims)
                i = np.flatnonzero((own[q] != u) & ~(d - tree.norm.max() > reach))
                if len(i):
                    at[i], dist[i] = tree.search(y[q[i]], d[i], bound[q[i]], np.concatenate([rank[: len(x)], rank[len(x) + q[i]]]), k, (at[i], dist[i]))
            a, r = np.nonzero(np.isfinite(dist))
            out.append(pa.table({"id": who.take(pa.array(q[a])), "neighbor": ids.take(pa.array(at[a, r])), "d": pa.array(dist[a, r])}))
        return pa.concat_tables(out)

    far = asked.groupBy("bundle", "share").cogroup(rows.join(F.broadcast(sent), "bundle").groupBy("bundle", "share")).applyInArrow(visit, f"id {kind}, neighbor {kind}, d double")
    near = bounded.select("id", F.explode("near").alias("x")).select("id", "x.neighbor", "x.d")
    best = near.unionByName(far).groupBy("id", "neighbor").agg(F.min("d").alias("d"))
    place = Window.partitionBy("id").orderBy("d", "neighbor")
    best = best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return best.select(F.col("id").alias(id_col), "rank", "neighbor", F.round("d", 6).alias("distance"))


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id neighbor, list_distance(a.e, b.e) d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor) k FROM p)
SELECT vec_id, CAST(k AS INTEGER) AS rank, neighbor, round(d, 6) AS distance FROM r WHERE k <= 10
"""
