"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

The unit that is placed is a group of rows with equal text, so copies share a shard; a group of more than a small share of a
shard is first cut into pieces by a hash of doc_id.  A unit has one coordinate per dimension (source, language, length), each
followed by a hash of the unit, which orders equal coordinates.  A node with k shards is split at the weight floor(k/2) : rest.

The weighted median is found by digits: one aggregate sums the weights by (node, next 16 bits), the bucket that holds the median
is kept, and only its units are read for the next 16 bits.  So a level of the tree costs a few narrow map-side combined aggregates
whatever the skew, and the driver sees at most one row per node, of which there are fewer than twice the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemtape.llm.common import parts_for, running, text_of
from tandemtape.session import cut

COORDINATE_BITS, DIGIT = 20, 16
TIE_BITS = 63 - COORDINATE_BITS


class Tree:
    """Nodes by number; leaves lead to themselves.  ``dim`` counts from 1."""

    def __init__(self, shards: int):
        self.dim, self.cut, self.left, self.right = [1], [0], [0], [0]
        self.first, self.shards = [0], [shards]

    def open_nodes(self) -> list[int]:
        return [n for n, k in enumerate(self.shards) if k > 1 and self.left[n] == n]

    def split(self, node: int, dim: int, at: int) -> None:
        k = self.shards[node]
        for first, shards in ((self.first[node], k // 2), (self.first[node] + k // 2, k - k // 2)):
            me = len(self.dim)
            for values, value in ((self.dim, 1), (self.cut, 0), (self.left, me), (self.right, me), (self.first, first), (self.shards, shards)):
                values.append(value)
        self.dim[node], self.cut[node], self.left[node], self.right[node] = dim, at, len(self.dim) - 2, len(self.dim) - 1

    def walk(self, depth: int) -> Column:
        """The node that a unit with coordinates ``_k`` has reached after ``depth`` steps."""
        if not depth:
            return F.lit(0)

        dim, at, left, right = (f"array({', '.join(f'{v}{kind}' for v in values)})" for values, kind in ((self.dim, ""), (self.cut, "L"), (self.left, ""), (self.right, "")))
        step = f"IF(get(_k, get({dim}, node) - 1) <= get({at}, node), get({left}, node), get({right}, node))"
        return F.expr(f"aggregate(sequence(1, {depth}), 0, (node, step) -> {step})")


def _of(values: dict, key: str, kind: str = "") -> Column:
    """The value of a key, for a few keys known beforehand."""
    return F.expr(f"element_at(map({', '.join(f'{k}, {v!r}{kind}' for k, v in values.items())}), {key})")


def _hash_coordinate(column: str) -> Column:
    value = F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column).cast("string")))
    return F.shiftrightunsigned(F.xxhash64(value), 64 - COORDINATE_BITS)


def _length_coordinate(column: Column) -> Column:
    """Log scale, so that long documents do not fill the range alone."""
    return F.least(F.floor(F.log2(column.cast("double") + 1.0) * (2.0 ** (COORDINATE_BITS - 6))), F.lit(2**COORDINATE_BITS - 1)).cast("long")


def _fit(units: DataFrame, total: int, shards: int, tolerance: float) -> tuple[Tree, int]:
    """Level by level: one aggregate finds the widest dimension and the bucket of the median of every open node, further ones refine."""
    tree, depth, root = Tree(shards), 0, None
    close = tolerance * total / shards
    while nodes := tree.open_nodes():
        here = units.withColumn("_node", tree.walk(depth)).where(F.col("_node").isin(nodes))
        share = {n: (tree.shards[n] // 2) / tree.shards[n] for n in nodes}
        every = here.select("_node", "_w", F.posexplode("_k").alias("_dim", "_key"))
        found = _buckets(every, 0, min(DIGIT, 63), share).collect()  # one row per open node and dimension
        if root is None:
            root = {r["_dim"]: max(r["span"], 1) for r in found}
        best: dict[int, object] = {}
        for r in sorted(found, key=lambda r: (-r["span"] / root[r["_dim"]], r["_dim"])):
            best.setdefault(r["_node"], r)
        # A node without units is split anyhow, so that every shard has a number.
        dim, at, state = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 2**63 - 1), {}
        for n, r in best.items():
            dim[n] = r["_dim"]
            state[n] = (r["digit"], r["upto"] - r["w"], r["w"], r["goal"])
        bits = DIGIT
        while True:
            rest = 63 - bits
            for n, (prefix, below, w, goal) in list(state.items()):
                if rest == 0 or w <= close:
                    over, under = below + w - goal, goal - below
                    at[n] = ((prefix + 1) << rest) - 1 if over <= under else (prefix << rest) - 1
                    del state[n]
            if not state:
                break
            step = min(DIGIT, rest)
            rows = here.where(F.col("_node").isin(list(state))).withColumn("_dim", _of({n: dim[n] for n in state}, "_node"))
            rows = rows.withColumn("_key", F.get("_k", F.col("_dim"))).where(F.shiftright("_key", rest) == _of({n: v[0] for n, v in state.items()}, "_node", "L"))
            goals = {n: v[3] - v[1] for n, v in state.items()}
            for r in _buckets(rows, bits, step, None, goals).collect():  # one row per open node
                prefix, below, _, goal = state[r["_node"]]
                state[r["_node"]] = ((prefix << step) | r["digit"], below + r["upto"] - r["w"], r["w"], goal)
            bits += step
        for n in nodes:
            tree.split(n, dim[n] + 1, at[n])
        depth += 1
    return tree, depth


def _buckets(rows: DataFrame, done: int, step: int, share: dict | None, goals: dict | None = None) -> DataFrame:
    """Per node and dimension the bucket of the next ``step`` bits in which the running weight reaches the goal."""
    sums = rows.groupBy("_node", "_dim", F.shiftright("_key", 63 - done - step).bitwiseAND(2**step - 1).alias("digit")).agg(F.sum("_w").alias("w"))
    whole = Window.partitionBy("_node", "_dim")
    order = whole.orderBy("digit")
    of_node = _of({n: float(v) for n, v in (share or goals).items()}, "_node", "D")
    summed = sums.select(
        "_node", "_dim", "digit", "w", F.sum("w").over(order).alias("upto"), F.lead("digit").over(order).alias("next"),
        (F.max("digit").over(whole) - F.min("digit").over(whole)).alias("span"), (of_node * F.sum("w").over(whole) if share else of_node).alias("goal"),
    )
    reached = (F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("w") < F.col("goal"))
    return summed.where(reached | F.col("next").isNull() & (F.col("upto") < F.col("goal")))


def kd_shards(docs: DataFrame, shards: int = 40, group_share: float = 0.02, tolerance: float = 0.005, rows_per_part: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; law is ``bytes``: shards are of nearly equal size.

    Size is the UTF-8 length of the text (none for null) plus 16.  A shard differs from its share by at most the largest unit
    along a path of splits: an equal-text group is a unit up to ``group_share`` of a shard, a longer document is one alone.
    Slots number a shard's rows from 0 without gaps.  Null and empty texts are equal texts; null source, language and doc_id are
    values of their own; repeated rows each get a slot.  Missing source or lang columns count as null.  An empty table gives an
    empty table, fewer units than shards leave shards empty.
    """
    for c in ("source", "lang"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    text = text_of("text")
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_h"), F.length(text).alias("_n"), _hash_coordinate("source").alias("_source"), _hash_coordinate("lang").alias("_lang"),
        )
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    # Groups above the limit: fewer than shards / group_share of them, so the side is bounded whatever the input.
    limit = max(group_share * total / shards, 1.0)
    large = rows.groupBy("_h").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_copies")).where((F.col("_bytes") > limit) & (F.col("_copies") > 1))
    large = large.select("_h", F.ceil(F.col("_bytes") / F.lit(limit)).alias("_pieces"))
    piece = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.col("_pieces"))
    rows = rows.join(F.broadcast(large), "_h", "left").withColumn("_u", F.when(F.col("_pieces").isNull(), F.col("_h")).otherwise(F.xxhash64("_h", piece))).drop("_pieces")
    tie = F.shiftrightunsigned(F.xxhash64("_u"), 64 - TIE_BITS)
    units = rows.groupBy("_u").agg(
        F.sum("size").alias("_w"), F.array(F.min("_source"), F.min("_lang"), _length_coordinate(F.max("_n"))).alias("_c")
    )
    units = cut(units.withColumn("_k", F.transform("_c", lambda c: F.shiftleft(c, TIE_BITS).bitwiseOR(tie))))
    tree, depth = _fit(units, total, shards, tolerance)
    placed = units.select("_u", F.get(F.expr(f"array({', '.join(map(str, tree.first))})"), tree.walk(depth)).alias("shard"))
    parts = parts_for(count, shards * rows_per_part)
    sharded = cut(rows.join(placed, "_u").withColumn("_part", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(parts))).withColumn("_one", F.lit(1)))
    slots = running(sharded, ["shard"], "_part", [F.col("doc_id"), F.col("_h")], "_one", "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
