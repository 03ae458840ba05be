"""Near-duplicate vectors by NN-descent.

Each vector keeps a list of its nearest neighbours.  Lists start from vectors that lie together
when all are sorted by random hyperplane codes.  In a round every vector shows the members of its
list, and the vectors that list it, to each other; what is closer than the end of a list enters
it.  Rounds go on until few entries change.  Pairs at the threshold are links, whether a list has
room for them or not, and their connected components the groups.

A list whose last entry is still a link is saturated: it cannot hold all links.  Vectors with such
lists keep a second list, of the nearest vector in each of the nearest other groups, found by a
descent of its own; its links join groups, and it is started anew until it has none.  Links inside a group
are counted by comparing all members, in blocks.  Recall is audited: a sample of vectors is
compared with all others.  Missing links between groups are added, and call for another descent
with longer lists from other codes; when links or groups stay short in the last one, it fails.

All similarities are cosines in double precision.  Equal vectors are one node with a weight.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.components import connected_components
from strandloom.session import saved

THRESHOLD = 0.9
#: Length of lists at first, sorted orders to start from, and how far neighbours are looked up in one.
LIST, ORDERS, REACH = 10, 4, 6
ROUNDS, CHANGED = 6, 0.002
#: Vectors audited against all others, the recall asked for, and how often the descent may start again.
AUDITED, RECALL, ATTEMPTS = 256, 0.999, 4
#: Members of a group compared at once.
BLOCK = 512
_PREFIX, _BITS = 12, 48


def nodes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of every row, and node, v (its bytes), dim, weight and first (smallest id) of distinct vectors.

    Rows whose vector is null, empty, zero or not finite throughout have no node.
    """
    usable = F.expr("coalesce(size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157e308) "
                    "and exists(v, x -> x <> 0), false)")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch["v"].to_pylist():
                x = np.array(v, np.float64)
                out.append(x.tobytes() if (x != x.astype(np.float32)).any() else x.astype(np.float32).tobytes())
            dims = [len(v) for v in batch["v"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(out, pa.binary()), pa.array(dims, pa.int32()), batch["weight"], batch["first"]],
                                             names=["node", "v", "dim", "weight", "first"])

    nodes = (rows.where("node is not null").groupBy("node", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"))
             .mapInArrow(packed, "node long, v binary, dim int, weight long, first long"))
    return rows.select("vec_id", "node"), nodes


def unit(column: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of packed ones; single-precision bytes hold values that are exact in them."""
    out = np.empty((len(column), dim))
    double = np.fromiter(map(len, column), np.int64, len(column)) == 8 * dim
    for mine, kind in ((double, np.float64), (~double, np.float32)):
        if mine.any():
            out[mine] = np.frombuffer(b"".join(column if mine.all() else itertools.compress(column, mine)), kind).reshape(-1, dim)
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _links(a, b, similarity) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(similarity, pa.float64())], names=["a", "b", "s"])


_LINK = "a long, b long, s double"


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A sorted partition in tables of whole runs of rows with equal keys, and the bounds of their runs."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        columns = [table[k].to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = np.concatenate([[0], cut])
        if len(cut):
            yield table.slice(0, bounds[-1]), bounds
        rest = table.slice(bounds[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys of a sorted partition, one table for each."""
    for table, bounds in whole_runs(batches, keys):
        for a, b in itertools.pairwise(bounds.tolist()):
            yield table.slice(a, b - a)


def compared(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The similarities inside the groups of a partition sorted by center, groups of one size at once, and columns ``names`` of their members."""
    for table, bounds in whole_runs(batches, ["center"]):
        columns = [table[c].to_numpy() for c in names]
        raw, starts, sizes = table["v"].to_pylist(), bounds[:-1], np.diff(bounds)
        dims = table["dim"].to_numpy()[starts]  # vectors of a group have one length
        for dim, size in np.unique(np.stack([dims, sizes]), axis=1).T.tolist():
            at = starts[(dims == dim) & (sizes == size)][:, None] + np.arange(size)
            x = unit([raw[i] for i in at.ravel().tolist()], dim).reshape(*at.shape, dim)
            yield x @ x.transpose(0, 2, 1), *[c[at] for c in columns]


def started(nodes: DataFrame, seed: int, orders: int, reach: int) -> DataFrame:
    """Pairs (a, b, s) of vectors near each other in some sorted order of hyperplane codes."""
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            node, raw, dims = batch["node"].to_numpy(), batch["v"].to_pylist(), batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, orders * _BITS))
                mine = np.flatnonzero(dims == dim)
                v = [raw[i] for i in mine]
                bits = (unit(v, dim) @ planes[dim] > 0).reshape(len(mine), orders, _BITS)
                code = bits @ (1 << np.arange(_BITS, dtype=np.int64)[::-1])
                for t in range(orders):
                    yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(v, pa.binary()), pa.array(np.full(len(mine), dim, np.int32)),
                                                      pa.array(np.full(len(mine), t, np.int32)), pa.array(code[:, t])],
                                                     names=["node", "v", "dim", "t", "code"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty((0, 2), np.int64), [])  # the last rows: (order and dimension, node), vectors
        for batch in batches:
            own = np.stack([batch["t"].to_numpy().astype(np.int64) << 32 | batch["dim"].to_numpy(), batch["node"].to_numpy()], axis=1)
            keys, raw = np.concatenate([held[0], own]), held[1] + batch["v"].to_pylist()
            old = len(held[0])
            out = [[], [], []]
            for key in np.unique(keys[:, 0]).tolist():
                mine = np.flatnonzero(keys[:, 0] == key)
                x, ids = unit([raw[i] for i in mine], key & 0xFFFFFFFF), keys[mine, 1]
                for step in range(1, min(reach, len(mine) - 1) + 1):
                    new = np.flatnonzero(mine[step:] >= old)
                    if len(new):
                        s = np.einsum("ij,ij->i", x[new], x[new + step])
                        for o, c in zip(out, (ids[new], ids[new + step], s), strict=True):
                            o.append(c)
            held = (keys[-reach:], raw[-reach:])
            yield _links(*(np.concatenate(o) if o else [] for o in out))

    coded = nodes.select("node", "v", "dim").mapInArrow(codes, "node long, v binary, dim int, t int, code long")
    prefix = F.shiftright("code", _BITS - _PREFIX)
    return (coded.repartition(width, "t", "dim", prefix).sortWithinPartitions("t", "dim", "code", "node")
            .select("node", "v", "dim", "t").mapInArrow(near, _LINK))


def _lists(pairs: DataFrame, length: int) -> DataFrame:
    """The ``length`` nearest of each vector, from pairs in either direction: node, other, s, last (the end of a full list)."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "s").unionByName(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "s")).where("node <> other").groupBy("node", "other").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("s"), "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= length)


def descended(nodes: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """Pairs found by showing the members of each neighbourhood to each other.

    Those with s are nearer than the end of a list; those that are ``linked`` lie in one group.
    """
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = lists.groupBy("node").agg(F.min(F.when(F.col("rank") == length, F.col("s"))).alias("end"))
    # a list may be named by very many; its nearest namers stand for all of them here
    namer = F.row_number().over(Window.partitionBy("other").orderBy(F.desc("s"), "node"))
    back = lists.withColumn("back", namer).where(F.col("back") <= length).select(F.col("other").alias("center"), F.col("node").alias("member"))
    shown = lists.select(F.col("node").alias("center"), F.col("other").alias("member")).unionByName(back).distinct()
    holding = nodes.select(F.col("node").alias("member"), "v", "dim").join(ends.withColumnRenamed("node", "member"), "member", "left")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, ids, end in compared(batches, "member", "end"):
            end, size = np.nan_to_num(end, nan=-2.0), ids.shape[1]
            i, j = np.triu_indices(size, 1)
            near = s[:, i, j]
            g, k = np.nonzero((near > end[:, i]) | (near > end[:, j]))
            # full lists have no room for a link: each member with the first one that it is linked with
            some = np.flatnonzero((near >= THRESHOLD).any(axis=1))
            linked = (s[some] >= THRESHOLD) | np.eye(size, dtype=bool)
            first, old = np.where(linked, np.arange(size), size).min(axis=2, initial=size), None
            while old is None or (first != old).any():
                old, first = first, np.where(linked, first[:, None, :], size).min(axis=2, initial=size)
            h, more = np.nonzero(first != np.arange(size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[g, i[k]], ids[some[h], more]])), pa.array(np.concatenate([ids[g, j[k]], ids[some[h], first[h, more]]])),
                 pa.array(np.concatenate([near[g, k], np.zeros(len(more))]), mask=np.arange(len(g) + len(more)) >= len(g)),
                 pa.array(np.concatenate([near[g, k] >= THRESHOLD, np.ones(len(more), bool)]))], names=["a", "b", "s", "linked"])

    met = (shown.join(holding, "member").repartition(width, "center").sortWithinPartitions("center")
           .select("center", "member", "v", "dim", "end").mapInArrow(meet, f"{_LINK}, linked boolean"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", "linked").groupBy("a", "b").agg(
        F.max("s").alias("s"), F.max("linked").alias("linked"))


def descent(nodes: DataFrame, seed: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of one group that an NN-descent saw, and its lists."""
    start = saved(started(nodes, seed, ORDERS, REACH))
    seen = start.where((F.col("s") >= THRESHOLD) & (F.col("a") != F.col("b"))).select("a", "b")
    lists = saved(_lists(start, length))
    for _ in range(ROUNDS):
        old = lists.select(F.col("node").alias("a"), F.col("other").alias("b"), "s")
        met = saved(descended(nodes, lists, length))
        seen = seen.unionByName(met.where("linked").select("a", "b"))
        new = saved(_lists(old.unionByName(met.where("s is not null").select("a", "b", "s")), length))
        fresh = new.join(lists, ["node", "other"], "left_anti").count()
        lists = new
        if fresh <= CHANGED * max(1, new.count()):
            break
    return seen.unionByName(lists.where(F.col("s") >= THRESHOLD).select(F.col("node").alias("a"), F.col("other").alias("b"))).distinct(), lists


def _outer(pairs: DataFrame, of: DataFrame, length: int) -> DataFrame:
    """The nearest vector in each of the ``length`` nearest other components of each vector: node, other, s, rank."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "s").unionByName(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "s"))
    theirs = of.select(F.col("node").alias("other"), F.col("component").alias("theirs"))
    best = (both.join(of, "node").join(theirs, "other").where("component <> theirs")
            .groupBy("node", "theirs").agg(F.max(F.struct("s", "other")).alias("best")).select("node", "best.other", "best.s"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("s"), "other"))
    return best.withColumn("rank", rank).where(F.col("rank") <= length)


def crossed(nodes: DataFrame, lists: DataFrame, component: DataFrame, seed: int, length: int) -> DataFrame | None:
    """Links (a, b) between components among the vectors whose lists are full of links, or None without any.

    Only such vectors can miss links for the length of their lists.  They descend on lists that
    leave out their own component, starting from all of them and from a few of each component.
    """
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = lists.where((F.col("rank") == length) & (F.col("s") >= THRESHOLD)).select("node")
    of = saved(component.join(full, "node").select("node", "component"))
    if of.select("component").distinct().limit(2).count() < 2:
        return None
    ours = saved(nodes.select("node", "v", "dim").join(of, "node"))
    inside = saved(lists.select("node", "other", "s").join(of.select("node"), "node", "left_semi")
                   .join(of.select(F.col("node").alias("other")), "other", "left_semi"))
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    draw = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = ours.join(sizes, "component").where((F.col("node") == F.col("first")) | (draw * F.col("n") < 2)).select("node", "v", "dim")

    def named(entries: DataFrame) -> DataFrame:
        namer = F.row_number().over(Window.partitionBy("other").orderBy(F.desc("s"), "node"))
        return entries.select(F.col("node").alias("center"), F.col("other").alias("member")).unionByName(
            entries.withColumn("back", namer).where(F.col("back") <= length).select(F.col("other").alias("center"), F.col("node").alias("member")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, ids, comp, end in compared(batches, "member", "component", "end"):
            g, i, j = np.nonzero((comp[:, :, None] != comp[:, None, :]) & (s > np.nan_to_num(end, nan=-2.0)[:, :, None]))
            found, theirs = s[g, i, j], comp[g, j]
            order = np.lexsort((-found, theirs, i, g))  # the nearest of each other component
            g, i, j, found, theirs = (x[order] for x in (g, i, j, found, theirs))
            best = np.ones(len(g), bool)
            best[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (theirs[1:] != theirs[:-1])
            yield _links(ids[g, i][best], ids[g, j][best], found[best])

    near = saved(named(inside).unionByName(of.select(F.col("node").alias("center"), F.col("node").alias("member"))))
    outer = saved(_outer(started(ours.drop("component"), seed, ORDERS, REACH).unionByName(started(few, seed, ORDERS, REACH)), of, length))
    for _ in range(ROUNDS):
        ends = outer.where(F.col("rank") == length).select(F.col("node").alias("member"), F.col("s").alias("end"))
        holding = ours.withColumnRenamed("node", "member").join(ends, "member", "left")
        met = (near.unionByName(named(outer)).distinct().join(holding, "member").repartition(width, "center").sortWithinPartitions("center")
               .select("center", "member", "v", "dim", "component", "end").mapInArrow(meet, _LINK))
        new = saved(_outer(outer.select(F.col("node").alias("a"), F.col("other").alias("b"), "s").unionByName(met), of, length))
        fresh = new.join(outer, ["node", "other"], "left_anti").count()
        outer = new
        if fresh <= CHANGED * max(1, new.count()):
            break
    links = outer.where(F.col("s") >= THRESHOLD).select(F.col("node").alias("a"), F.col("other").alias("b"))
    return None if links.isEmpty() else links


def audit(nodes: DataFrame, component: DataFrame, seed: int = 0) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """Recall of a sample of vectors compared with all.

    Their links, those inside one component, their components that have links, those of them
    without a link to another, and pairs of the links between components.
    """
    spark = nodes.sparkSession
    placed = nodes.select("node", "v", "dim").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    share = AUDITED / max(1, nodes.count())
    draw = F.pmod(F.xxhash64("node", F.lit(3 + seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = placed.where(draw < share).collect()  # about AUDITED vectors
    asked: dict[int, list] = {}
    for r in sample:
        asked.setdefault(r["dim"], []).append((r["node"], bytes(r["v"]), r["component"]))
    shared = spark.sparkContext.broadcast(asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = together = 0
        pairs, groups, broken = [[], []], set(), set()
        for batch in batches:
            node, comp, dims, raw = batch["node"].to_numpy(), batch["component"].to_numpy(), batch["dim"].to_numpy(), batch["v"].to_pylist()
            for dim, queries in shared.value.items():
                mine = np.flatnonzero(dims == dim)
                if len(mine):
                    q = unit([v for _, v, _ in queries], dim)
                    ids, comps = np.array([n for n, _, _ in queries]), np.array([c for _, _, c in queries])
                    i, j = np.nonzero(unit([raw[k] for k in mine], dim) @ q.T >= THRESHOLD)
                    other = node[mine[i]] != ids[j]
                    i, j = mine[i[other]], j[other]
                    same = comp[i] == comps[j]
                    true, together = true + len(i), together + int(same.sum())
                    groups.update(comps[j].tolist())
                    broken.update(comps[j][~same].tolist())
                    # one missing pair for each query and component joins them
                    _, first = np.unique(np.stack([comps[j][~same], comp[i][~same]]), axis=1, return_index=True)
                    pairs[0] += node[i[~same][first]].tolist()
                    pairs[1] += ids[j[~same][first]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([true]), pa.array([together]), *(pa.array([list(c)], pa.list_(pa.int64())) for c in (groups, broken, *pairs))],
                                         names=["true", "together", "groups", "broken", "a", "b"])

    rows = placed.mapInArrow(compare, "true long, together long, groups array<long>, broken array<long>, a array<long>, b array<long>").collect()
    groups, broken = {g for r in rows for g in r["groups"]}, {g for r in rows for g in r["broken"]}
    return (sum(r["true"] for r in rows), sum(r["together"] for r in rows), len(groups), len(groups - broken),
            [(a, b) for r in rows for a, b in zip(r["a"], r["b"], strict=True)])


def counted(nodes: DataFrame, component: DataFrame) -> DataFrame:
    """node, links: the weights of all vectors linked with each one, its group compared in blocks."""
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = nodes.select("node", "v", "dim", "weight").join(component, "node")
    blocks = component.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    members = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = members.select("component", "node", "v", "dim", "weight", "block", every.alias("with")).select(
        "component", "node", "v", "dim", "weight", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["component", "i", "j"]):
            ids, w, block = group["node"].to_numpy(), group["weight"].to_numpy(), group["block"].to_numpy()
            x = unit(group["v"].to_pylist(), group["dim"][0].as_py())
            left = block == group["i"][0].as_py()
            right = left if group["i"][0] == group["j"][0] else ~left
            linked = x[left] @ x[right].T >= THRESHOLD
            if right is left:
                np.fill_diagonal(linked, False)
                found = [(ids[left], linked @ w[left])]
            else:
                found = [(ids[left], linked @ w[right]), (ids[right], linked.T @ w[left])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a for a, _ in found])), pa.array(np.concatenate([b for _, b in found]))],
                                             names=["node", "links"])

    return (paired.repartition(width, "component", "i", "j").sortWithinPartitions("component", "i", "j")
            .mapInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")))


def near_duplicates(embeddings: DataFrame, length: int = LIST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite values, and vectors of other
    lengths, link with nothing.  Equal vectors under other or the same ids count as links of each
    other.  A null vec_id takes part; the component is the smallest id there is.  An empty table
    gives no rows; other columns are ignored.  Fails when the last audit misses too many links or groups.
    """
    rows, nodes = nodes_of(embeddings)
    nodes = saved(nodes)
    links, component = None, None
    for attempt in range(ATTEMPTS):
        found, lists = descent(nodes, attempt, length << attempt)
        links = saved(found if links is None else links.unionByName(found).distinct())
        component = saved(connected_components(links))
        while (more := crossed(nodes, lists, component, attempt, length << attempt)) is not None:
            links = saved(links.unionByName(more))
            component = saved(connected_components(links))
        true, together, groups, whole, missing = audit(nodes, component, attempt)
        if missing:
            more = nodes.sparkSession.createDataFrame(missing, "a long, b long")
            links = links.unionByName(more)
            component = saved(connected_components(links))
        if together >= RECALL * true and whole >= RECALL * groups:
            break
    else:
        raise RuntimeError(f"NN-descent found {together} of {true} audited links and {whole} of {groups} audited groups whole")
    of = nodes.select("node", "weight", "first").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = of.groupBy("component").agg(F.min("first").alias("component_id"))
    result = (of.join(lowest, "component").join(counted(nodes, component), "node", "left")
              .select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    return rows.join(result, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
