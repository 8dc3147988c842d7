"""Exact largest inner products by dual-tree search over cover trees.

Queries and data are indexed together: pivots, spread by farthest-first choice over a bounded sample, form the upper level, and every row
goes to its nearest pivot.  A pivot's rows make blocks of at most about ``block_rows`` rows, its queries make groups, and each block
and group holds a cover tree: a node covers its rows within its radius, its children's centres lie more than two thirds of that radius
apart and cover its rows within two thirds; a level that would not coarsen is left out, so its node is a leaf.

For centres p, q and radii s, t no product of a row of each exceeds <p, q> + s|q| + t|p| + st.  A pair of nodes whose bound is
under the worst kth score of the query node is pruned.  Each group first searches the block its centre points to, which gives kth scores;
with them the upper level prunes whole pivots, and what is left is searched pair by pair, best bound first.  Pruning drops no
tie, since a pair must be strictly worse.

Components become floor(1024 x).  Where every norm is under 2^26 products are exact in double precision.  Wider vectors are kept apart, meet
everything and are multiplied as whole numbers of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemtape.llm.common import drop_shuffles_early
from tandemtape.session import cut, release

SCALE, SHRINK, LEAF, MOST_CHILDREN = 1024, 1.5, 32, 256
NARROW = 2.0**26
WIDE = -1
LONGS = np.iinfo(np.int64)
#: Rows sampled for pivots, and numbers that all pivots hold together.
SAMPLE_ROWS, PIVOT_NUMBERS = 16_384, 1 << 20


def dense(vectors: pa.ListArray) -> np.ndarray:
    """A matrix of the vectors, short ones filled with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def floored(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def exact(row: np.ndarray) -> list[int]:
    """The floored components of one vector as whole numbers of any length."""
    return [int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in row.tolist()]


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products; components that one side lacks are zero."""
    width = min(x.shape[1], y.shape[1])
    return x[:, :width] @ y[:, :width].T


def away(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - center).sum(1))


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Rows chosen one by one, each the farthest from those before; no two are equal."""
    chosen = [0]
    left = away(x, x[0])
    while len(chosen) < most and left.max() > 0:
        chosen.append(int(left.argmax()))
        left = np.minimum(left, away(x, x[chosen[-1]]))
    return np.array(chosen)


@dataclass
class Tree:
    """Rows in tree order and the nodes over them; a node without children is a leaf.  Centres are rows."""

    uid: np.ndarray
    vec_id: np.ndarray
    x: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray

    def __post_init__(self):
        self.norm = np.sqrt(np.square(self.x[self.center]).sum(1))

    KINDS = {"uid": np.int64, "vec_id": np.int64, "x": np.float64, "center": np.int64, "radius": np.float64, "begin": np.int64, "end": np.int64, "child": np.int64, "children": np.int64}

    def packed(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.KINDS.items()}

    @classmethod
    def unpacked(cls, row: dict) -> Tree:
        columns = {name: np.frombuffer(row[name], kind) for name, kind in cls.KINDS.items()}
        columns["x"] = columns["x"].reshape(len(columns["uid"]), -1)
        return cls(**columns)


PACKED = ", ".join(f"{name} binary" for name in Tree.KINDS)


def grow(uid: np.ndarray, vec_id: np.ndarray, x: np.ndarray) -> Tree:
    """The cover tree of some rows; breadth first, so the children of a node stand side by side."""
    root = int(away(x, x.mean(0)).argmin())
    everything = np.arange(len(x))
    nodes: list[list] = [[root, everything, away(x, x[root]), 0, 0]]  # centre, rows, distances to it, first child, children
    at = 0
    while at < len(nodes):
        center, rows, left, _, _ = nodes[at]
        radius, centers, owner, best = left.max(), [center], np.zeros(len(rows), np.int64), left.copy()
        allowed = min(len(rows) // 4, MOST_CHILDREN) if len(rows) > LEAF and radius > 0 else 0
        while len(centers) <= allowed and best.max() > radius / SHRINK:
            centers.append(int(rows[best.argmax()]))
            to_new = away(x[rows], x[centers[-1]])
            owner[to_new < best] = len(centers) - 1
            best = np.minimum(best, to_new)
        if 1 < len(centers) <= allowed:
            nodes[at][3:] = len(nodes), len(centers)
            nodes.extend([c, rows[owner == i], best[owner == i], 0, 0] for i, c in enumerate(centers))
        at += 1
    begin, order = np.zeros(len(nodes), np.int64), []

    def lay(n: int, start: int) -> None:
        pending = [(n, start)]
        while pending:
            node, start = pending.pop()
            begin[node] = start
            _, rows, _, first, count = nodes[node]
            if not count:
                order.append((start, rows))
            for child in range(first, first + count):
                pending.append((child, start))
                start += len(nodes[child][1])

    lay(0, 0)
    order = np.concatenate([rows for _, rows in sorted(order, key=lambda leaf: leaf[0])])
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    sizes = np.array([len(n[1]) for n in nodes])
    return Tree(uid[order], vec_id[order], x[order], place[[n[0] for n in nodes]], np.array([n[2].max() for n in nodes]), begin, begin + sizes, np.array([n[3] for n in nodes]), np.array([n[4] for n in nodes]))


def upper_bound(products, radius_a, norm_a, radius_b, norm_b):
    """No inner product of a row of each side is larger; the last part covers rounding."""
    return products + radius_a * norm_b + radius_b * norm_a + radius_a * radius_b + 1e-9 * (norm_a + radius_a) * (norm_b + radius_b)


class Best:
    """The k best rows found for every query of a group, from a starting kth score on."""

    def __init__(self, queries: int, k: int, worst: np.ndarray):
        self.k, self.worst = k, worst.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * queries

    def offer(self, first: int, scores: np.ndarray, vec_id: np.ndarray, uid: np.ndarray) -> None:
        """Scores of the queries from ``first`` on with some rows; -inf where a row is the query itself."""
        for i in np.flatnonzero(scores.max(1, initial=-np.inf) >= self.worst[first : first + len(scores)]):
            row, q = scores[i], first + i
            least = max(self.worst[q], np.partition(row, -self.k)[-self.k]) if len(row) > self.k else self.worst[q]
            pick = np.flatnonzero((row >= least) & (row > -np.inf))
            had = self.found[q]
            s, v, u = (np.concatenate(pair) for pair in zip(had, (row[pick], vec_id[pick], uid[pick])))
            order = np.lexsort((v, -s))[: self.k]
            self.found[q] = s[order], v[order], u[order]
            if len(order) == self.k:
                self.worst[q] = max(self.worst[q], s[order[-1]])


def dual_search(queries: Tree, data: Tree, best: Best) -> int:
    """Offer ``best`` every row of ``data`` that may be among the best of a query; returns how many products it took."""
    taken, pending = 0, [(np.inf, 0, 0)]
    while pending:
        bound, q, d = pending.pop()
        qa, qb = queries.begin[q], queries.end[q]
        if bound < best.worst[qa:qb].min():
            continue
        down_data = data.children[d] > 0 and (not queries.children[q] or data.radius[d] >= queries.radius[q])
        if not down_data and not queries.children[q]:
            da, db = data.begin[d], data.end[d]
            scores = products(queries.x[qa:qb], data.x[da:db])
            scores[queries.uid[qa:qb, None] == data.uid[None, da:db]] = -np.inf
            taken += scores.size
            best.offer(qa, scores, data.vec_id[da:db], data.uid[da:db])
            continue
        qs = np.array([q]) if down_data else np.arange(queries.child[q], queries.child[q] + queries.children[q])
        ds = np.arange(data.child[d], data.child[d] + data.children[d]) if down_data else np.array([d])
        met = products(queries.x[queries.center[qs]], data.x[data.center[ds]]).ravel()
        bounds = upper_bound(met, queries.radius[qs], queries.norm[qs], data.radius[ds], data.norm[ds])
        pairs = [(b, int(qs[i] if len(qs) > 1 else qs[0]), int(ds[i] if len(ds) > 1 else ds[0])) for i, b in enumerate(bounds)]
        pending.extend(sorted(pairs))
    return taken


def ordered(value: int) -> bytes:
    """Bytes that sort as the whole numbers do."""
    size = value.bit_length() // 8 + 1
    head = (1 << 31) + (size if value >= 0 else -size)
    return head.to_bytes(4) + (value if value >= 0 else value + (1 << (8 * size))).to_bytes(size)


FOUND = "group int, query_uid long, query_id long, uid long, vec_id long, score long, by binary"


def _result(group: int, rows: list[tuple[int, int, int, int, int]]) -> pa.Table:
    """Rows (query_uid, query_id, uid, vec_id, score); scores beyond 64 bits are set to the nearest long."""
    columns = list(zip(*rows)) if rows else [()] * 5
    kept = [min(max(s, LONGS.min), LONGS.max) for s in columns[4]]
    by = [ordered(s) for s in columns[4]]
    arrays = [pa.array(c, pa.int64()) for c in (*columns[:3], [None if v == LONGS.max else v for v in columns[3]], kept)]
    return pa.Table.from_arrays([pa.array([group] * len(by), pa.int32()), *arrays, pa.array(by, pa.binary())], ["group", "query_uid", "query_id", "uid", "vec_id", "score", "by"])


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """uid and vec_id; no vec_id becomes the largest long, which loses every tie."""
    return table["uid"].to_numpy(), table["vec_id"].fill_null(LONGS.max).to_numpy()


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each row with its nearest pivot and its distance, or ``WIDE``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floored(dense(batch.column("x")))
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.sqrt(np.square(x).sum(1))
            narrow = norms < NARROW
            pivot, apart = np.full(len(x), WIDE), np.zeros(len(x))
            if narrow.any() and len(pivots):
                own = widened(x[narrow], pivots.shape[1])
                centers = widened(pivots, own.shape[1])
                near = np.concatenate([(np.square(centers).sum(1) - 2 * own[a : a + 1024] @ centers.T).argmin(1) for a in range(0, len(own), 1024)])
                pivot[narrow], apart[narrow] = near, away(own, centers[near])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(apart), pa.array(np.where(narrow, norms, np.inf))], [*batch.schema.names, "pivot", "apart", "norm"])

    return rows.mapInArrow(place, "uid long, vec_id long, x array<double>, pivot int, apart double, norm double")


def _indexed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A packed cover tree per key; wide rows stay as they are, in one leaf."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        uid, vec_id = _ids(table)
        x = dense(table["x"])
        pivot = key[0].as_py()
        if pivot == WIDE:
            one = np.zeros(1, np.int64)
            with np.errstate(over="ignore"):
                tree = Tree(uid, vec_id, x, one, np.array([np.inf]), one, np.array([len(x)]), one, one)
        else:
            tree = grow(uid, vec_id, floored(x))
        packed = tree.packed()
        columns = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([packed[name]], pa.binary()) for name in Tree.KINDS]
        return pa.Table.from_arrays(columns, [*keys, *Tree.KINDS])

    return rows.groupBy(*keys).applyInArrow(build, ", ".join(f"{k} int" for k in keys) + ", " + PACKED)


def _whole_numbers(tree: Tree, wide: bool) -> list[list[int]]:
    return [exact(row) for row in tree.x] if wide else [[int(v) for v in row] for row in tree.x.tolist()]


def _searched(visits: DataFrame, blocks: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """The k best of each visit (pivot, part, group) for every query of the group, as far as they reach its kth score so far."""
    visits = visits.select("pivot", "part", "group")
    left = visits.join(blocks, ["pivot", "part"])
    again = visits.select(*[F.col(c).alias(c) for c in visits.columns])
    right = again.join(groups.withColumnRenamed("pivot", "home"), "group").select("pivot", "part", "group", "home", "worst", *Tree.KINDS)

    def search(block: pa.Table, group: pa.Table) -> pa.Table:
        if not block.num_rows or not group.num_rows:
            return _result(0, [])
        block, group = block.to_pylist()[0], group.to_pylist()[0]
        data, queries = Tree.unpacked(block), Tree.unpacked(group)
        worst = np.frombuffer(group["worst"], np.float64) if group["worst"] else np.full(len(queries.uid), -np.inf)
        if WIDE in (block["pivot"], group["home"]):
            rows, theirs, found = _whole_numbers(data, block["pivot"] == WIDE), _whole_numbers(queries, group["home"] == WIDE), []
            for q, own in enumerate(theirs):
                scored = sorted((-sum(a * b for a, b in zip(own, row)), v, u) for row, v, u in zip(rows, data.vec_id.tolist(), data.uid.tolist()) if u != queries.uid[q])
                found += [(int(queries.uid[q]), int(queries.vec_id[q]), u, v, -s) for s, v, u in scored[:k]]
            return _result(group["group"], found)
        best = Best(len(queries.uid), k, worst)
        dual_search(queries, data, best)
        return _result(group["group"], [(int(queries.uid[q]), int(queries.vec_id[q]), int(u), int(v), int(s)) for q, found in enumerate(best.found) for s, v, u in zip(*found)])

    keys = ["pivot", "part", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)


def _with_worst(groups: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The groups with the kth scores of their queries, in tree order; -inf where fewer rows were found."""

    def fill(group: pa.Table, found: pa.Table) -> pa.Table:
        if not group.num_rows:
            return group.append_column("worst", pa.array([], pa.binary()))
        place = {uid: q for q, uid in enumerate(np.frombuffer(group["uid"][0].as_py(), np.int64).tolist())}
        count, worst = np.zeros(len(place), np.int64), np.full(len(place), np.inf)
        at = np.array([place[uid] for uid in found["query_uid"].to_pylist()], np.int64)
        np.add.at(count, at, 1)
        np.minimum.at(worst, at, found["score"].to_numpy().astype(np.float64))
        return group.append_column("worst", pa.array([np.where(count < k, -np.inf, worst).tobytes()], pa.binary()))

    return groups.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(fill, "pivot int, group int, " + PACKED + ", worst binary")


def search(vectors: DataFrame, every: int = 100, k: int = 10, block_rows: int = 4096, group_rows: int = 512) -> DataFrame:
    """The k largest inner products of each query with all other rows: query_id, rank, vec_id, score, query_hash.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own row, in tasks of one block
    and one group.  Ties go to the smaller vec_id.

    ``vectors`` has vec_id and embedding; other columns are ignored.  Vectors that are null or hold a null or non-finite component take no
    part; an empty vector is all zeros, as are the components that a shorter one lacks.  Without vec_id a row is a candidate only and
    loses ties.  Rows that share a vec_id, equal or not, are queries and candidates each for itself; ``query_hash`` tells queries of one
    vec_id apart (equal rows get equal results).  Scores beyond 64 bits rank exactly and are shown as the nearest long.  No rows: no rows.
    Runs jobs when called.
    """
    spark = vectors.sparkSession
    drop_shuffles_early(spark)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("x").isNotNull()).where(F.forall("x", finite))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "x"))
    size, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    wanted = min(-(-size // block_rows), SAMPLE_ROWS, max(PIVOT_NUMBERS // max(width or 1, 1), 1))
    sample_rows = min(SAMPLE_ROWS, max(wanted, (1 << 22) // max(width or 1, 1)))
    sampled = rows.select("x").orderBy(F.xxhash64("uid")).limit(sample_rows).toArrow()
    sample = floored(dense(sampled["x"])) if sampled.num_rows else np.zeros((0, 0))
    with np.errstate(over="ignore"):
        sample = sample[np.square(sample).sum(1) < NARROW**2]
    pivots = sample[farthest_first(sample, wanted)] if len(sample) else sample
    placed = cut(_placed(rows, pivots))
    is_query = F.col("vec_id") % every == 0

    kinds = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius"), F.count(F.when(is_query, 1)).alias("queries"), F.max(F.when(is_query, F.col("apart"))).alias("query_radius")).toPandas()
    n, queries = dict(zip(kinds["pivot"], kinds["n"])), dict(zip(kinds["pivot"], kinds["queries"]))
    parts = {p: max(1, -(-c // block_rows)) for p, c in n.items()}
    # Groups are numbered through over all pivots; a pivot's queries are dealt to its groups by hash.
    teams, first = {p: -(-c // group_rows) for p, c in queries.items()}, {}
    for p in sorted(teams):
        first[p] = sum(teams[o] for o in first)
    if not sum(teams.values()):
        release(spark, rows, placed)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, query_hash long")
    per_pivot = spark.createDataFrame([(int(p), int(parts[p]), int(max(teams[p], 1)), int(first[p])) for p in n], "pivot int, parts int, teams int, first int")
    dealt = placed.join(F.broadcast(per_pivot), "pivot")  # At most SAMPLE_ROWS + 1 rows.
    spread = lambda many: F.pmod(F.xxhash64("uid"), F.col(many)).cast("int")
    blocks = cut(_indexed(dealt.select("pivot", spread("parts").alias("part"), "uid", "vec_id", "x"), ["pivot", "part"]))
    asked = dealt.where(is_query).select("pivot", (F.col("first") + spread("teams")).alias("group"), "uid", "vec_id", "x")
    groups = cut(_indexed(asked, ["pivot", "group"]).select(F.col("pivot"), F.col("group"), *Tree.KINDS))

    radius = np.array([kinds["radius"][kinds["pivot"] == p].max() if p in n else -1.0 for p in range(len(pivots))])
    query_radius = dict(zip(kinds["pivot"], kinds["query_radius"]))
    norms = np.sqrt(np.square(pivots).sum(1))
    full = [p for p in range(len(pivots)) if n.get(p, 0) > k] or list(n)

    likely = [int(p) for p in n if p != WIDE and n[p] > k] or [int(p) for p in n]

    def home_of(p: int) -> int:
        """The pivot whose rows the queries of ``p`` meet first: the largest product of centres."""
        return likely[int((pivots[likely] @ pivots[p]).argmax())] if WIDE not in (p, likely[0]) else likely[0]

    homes = spark.createDataFrame([(int(p), home_of(int(p))) for p in n], "own int, pivot int")
    named = groups.select(F.col("pivot").alias("own"), "group")
    seeds = named.join(F.broadcast(homes), "own").select("pivot", F.lit(0).alias("part"), "group")
    begun = cut(_searched(seeds, blocks, groups.withColumn("worst", F.lit(None).cast("binary")), k))
    known = cut(_with_worst(groups, begun, k))

    part_counts = {int(p): int(parts[p]) for p in n}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that each group must see, less the one it began with."""
        for batch in batches:
            out = []
            for own, group, worst in zip(*(batch.column(c).to_pylist() for c in ("pivot", "group", "worst"))):
                least = np.frombuffer(worst, np.float64).min()
                for p in sorted(part_counts):
                    if WIDE not in (p, own):
                        most = upper_bound(float(pivots[own] @ pivots[p]), query_radius[own], norms[own], radius[p], norms[p])
                        if most < least:
                            continue
                    out += [(p, part, group) for part in range(part_counts[p]) if (p, part) != (home_of(own), 0)]
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], ["pivot", "part", "group"])

    visits = cut(known.select("pivot", "group", "worst").mapInArrow(visit, "pivot int, part int, group int"))
    found = begun.unionByName(_searched(visits, blocks, known, k))
    order = [F.desc("by"), F.asc_nulls_last("vec_id"), F.asc("uid")]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_uid").orderBy(*order))).where(F.col("rank") <= k)
    hashes = placed.where(is_query).select(F.col("uid").alias("query_uid"), F.xxhash64("x").alias("query_hash"))
    result = cut(found.join(hashes, "query_uid").select("query_id", "rank", "vec_id", "score", "query_hash"))
    release(spark, rows, placed, blocks, groups, begun, known, visits)
    return result
