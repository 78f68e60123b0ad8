"""Exact top-k inner products by cover trees on both sides.

Vectors are quantised to integers. The first levels of one tree are shared: at most PIVOTS points of a bounded sample, farthest first, to which every
vector belongs by nearness, with the covering radius of each over all of its vectors. Candidates of a pivot lie in blocks of about BLOCK rows, queries in groups of one
pivot. A query first meets one block of its best pivot, which gives a kth score that it can't fall below. It then goes only
to the pivots whose covering radius allows a product as large as that, so vectors meet in a task only where a bound allows it. There a cover tree over the block and one over the
queries are walked together, and a pair of nodes is passed over when the largest product that their covering radii allow is below the worst kth score of
the queries in the node. Blocks return k rows a query, and these are ranked together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import mapped, settled, stored

SCALE = 1024
QUERY_BLOCK, BLOCK = 1024, 8192
#: Points of a node that isn't parted further.
LEAF = 48
#: Pivots at most, and bytes of vectors in the sample that they are taken from.
PIVOTS, SAMPLE_ROWS, SAMPLE_BYTES = 256, 4096, 8 << 20
#: Rows of a table of counts that is broadcast.
MOST_GROUPS = 100_000


class Node:
    __slots__ = ("center", "norm", "radius", "rows", "children")

    def __init__(self, center, radius, rows, children):
        self.center, self.norm, self.radius, self.rows, self.children = center, float(np.sqrt(center @ center)), radius, rows, children


def farthest_first(points: np.ndarray, most: int, within: float = 0.0) -> tuple[list[int], np.ndarray, float]:
    """Numbers of points, each the farthest from those before, until all are `within` of one or there are `most`; the nearest one of each point; the largest distance left."""
    chosen, nearest = [0], np.zeros(len(points), np.int64)
    dist = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(chosen) < most and dist.max() > within:
        pick = int(dist.argmax())
        d = np.sqrt(((points - points[pick]) ** 2).sum(axis=1))
        closer = d < dist
        nearest[closer], dist = len(chosen), np.minimum(d, dist)
        chosen.append(pick)
    return chosen, nearest, float(dist.max())


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """A node covers its points within its radius. Its children's centers are points of it, its own center among them (nesting), lie more than half its radius apart
    (separation) and cover its points within that half (covering).

    Where that takes more centers than leaves of LEAF points would be, as far as points in many directions are equally far apart, the node is a leaf: bounds could pass over nothing there.
    """
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    center = own[0]
    radius = float(np.sqrt(((own - center) ** 2).sum(axis=1)).max(initial=0))
    if len(rows) <= LEAF or radius == 0:
        return Node(center, radius, rows, ())
    chosen, nearest, left = farthest_first(own, max(4, len(rows) // LEAF), radius / 2)
    if left > radius / 2:
        return Node(center, radius, rows, ())
    order = np.argsort(nearest, kind="stable")
    parts = np.split(rows[order], np.searchsorted(nearest[order], np.arange(1, len(chosen))))
    heads = rows[np.array(chosen)]
    return Node(center, radius, rows, tuple(cover_tree(points, np.concatenate([[h], p[p != h]])) for h, p in zip(heads, parts)))


def _compare(q, query_ids, a, p, ids, b, rank, k, best, worst) -> None:
    """Every query of rows a with every point of rows b: best and worst are brought up to date."""
    scores = q[a] @ p[b].T
    none = -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min
    scores[query_ids[a][:, None] == ids[b][None, :]] = none
    cut = worst[a]
    if len(b) > k:
        cut = np.maximum(cut, np.partition(scores, len(b) - k, axis=1)[:, len(b) - k])
    for t, i in enumerate(a.tolist()):
        good = np.flatnonzero((scores[t] >= cut[t]) & (scores[t] != none))
        if len(good):
            score = np.concatenate([best[i][0], scores[t][good].astype(np.int64)])
            who = np.concatenate([best[i][1], b[good]])
            top = np.lexsort((rank[who], -score))[:k]
            best[i] = (score[top], who[top])
            if len(top) == k:
                worst[i] = max(worst[i], score[top[-1]])


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None, tree: Node | None = None) -> list[tuple[int, int, int]]:
    """(number of the query, id, score) of the k best of points for each query, ties to the smaller id, rows with the query's id left out.

    Only scores from `least` on are told, where that is given. Both sides hold integers, as floats where all products are exact in them and as int64 otherwise.
    """
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * queries.shape[1] < 2**52
    fq, fp = queries.astype(np.float64), points.astype(np.float64)
    q, p = (fq, fp) if exact else (queries, points)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
    worst = np.full(len(query_ids), -np.inf) if least is None else least.astype(np.float64)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    if len(points) and len(queries):
        todo = [(np.inf, cover_tree(fq), tree or cover_tree(fp))]
        while todo:
            bound, a, b = todo.pop()
            if bound < worst[a.rows].min():
                continue
            if not a.children and not b.children:
                for i in range(0, len(a.rows), 256):
                    _compare(q, query_ids, a.rows[i : i + 256], p, ids, b.rows, rank, k, best, worst)
                continue
            left = a.children if a.children and (not b.children or a.radius > b.radius) else (a,)
            right = b.children if left == (a,) else (b,)
            pairs = []
            for x in left:
                for y in right:
                    most = float(x.center @ y.center) + x.norm * y.radius + y.norm * x.radius + x.radius * y.radius
                    pairs.append((most + 1 + abs(most) * 1e-9, x, y))
            todo += sorted(pairs, key=lambda z: z[0])  # the most promising one comes next
    return [(i, int(ids[w]), int(s)) for i, (score, who) in enumerate(best) for s, w in zip(score.tolist(), who.tolist())]


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and its components as floor(1024 * x); ids or vectors that are null, or hold null or non-finite components, are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("v"))


def _vectors(column, width: int) -> np.ndarray:
    """The rows of an Arrow list column whose lists all have `width` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _by_width(batch, at: int):
    """(width, rows) of a batch by the length of the lists in column `at`."""
    import pyarrow.compute as pc

    size = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for width in np.unique(size).tolist():
        yield width, batch.take(np.flatnonzero(size == width))


PLACED_SCHEMA = "vec_id long, v array<long>, width int, pivot int, far double, hash long"


def _placer(pivots):
    """Rows (vec_id, v, hash) with their width, the number of the nearest pivot of that width (-1 without one) and the distance to it."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for width, batch in _by_width(whole, 1):
                centers = pivots.value.get(width)
                pivot, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
                if centers is not None and width:
                    x = _vectors(batch.column(1), width).astype(np.float64)
                    for i in range(0, len(x), 1024):
                        part = x[i : i + 1024]
                        near = ((centers**2).sum(axis=1) - 2 * part @ centers.T).argmin(axis=1)
                        pivot[i : i + 1024] = near
                        far[i : i + 1024] = np.sqrt(((part - centers[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([width] * batch.num_rows, pa.int32()), pa.array(pivot), pa.array(far), batch.column(2)], names=["vec_id", "v", "width", "pivot", "far", "hash"])

    return run


BLOCK_SCHEMA = "width int, pivot int, split int, ids binary, hashes binary, vectors binary, least binary"


def _blocker(batches):
    """Rows (width, pivot, split, vec_id, hash, v, least) in that order -> one row for each width, pivot and split."""
    import pyarrow as pa

    names = [x.split(" ")[0] for x in BLOCK_SCHEMA.split(", ")]

    def out(key, held):
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), *(pa.array([b"".join(x)], pa.binary()) for x in zip(*held))], names=names)

    held, at = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for i, j in zip(edges[:-1], edges[1:]):
            if i == j:
                continue
            key, part = tuple(keys[i].tolist()), batch.slice(i, j - i)
            if held and key != at:
                yield out(at, held)
                held = []
            at = key
            ids, hashes, least = (part.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 6))
            held.append((ids.astype("<i8").tobytes(), hashes.astype("<i8").tobytes(), _vectors(part.column(5), key[0]).astype("<i8").tobytes(), least.astype("<f8").tobytes()))
    if held:
        yield out(at, held)


def _numbers(raw) -> np.ndarray:
    return np.frombuffer(raw, "<i8").astype(np.int64)


def _read(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = _numbers(row[f"{prefix}ids"])
    return ids, _numbers(row[f"{prefix}hashes"]), _numbers(row[f"{prefix}vectors"]).reshape(len(ids), row["width"])


SENT_SCHEMA = "width int, pivot int, q_ids binary, q_hashes binary, q_vectors binary, q_least binary"


def _sender(pivots, radii, first: bool):
    """Blocks of queries -> what goes to each pivot: the queries that may still find better there than their kth score so far; or all, to the best pivot alone."""

    def run(batches):
        import pyarrow as pa

        names = [x.split(" ")[0] for x in SENT_SCHEMA.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                ids, hashes, x = _read(row)
                least, centers = np.frombuffer(row["least"], "<f8"), pivots.value.get(row["width"])
                where = np.array([-1]) if centers is None else np.arange(len(centers))
                bound = np.full((len(ids), len(where)), np.inf)
                if centers is not None:
                    bound = x @ centers.T + np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * radii.value[row["width"]]
                    bound += 1 + np.abs(bound) * 1e-9
                wanted = bound >= least[:, None]
                if first:
                    wanted = np.broadcast_to(np.arange(len(where)) == bound.max(axis=0).argmax(), bound.shape)
                for g in np.flatnonzero(wanted.any(axis=0)).tolist():
                    own = wanted[:, g]
                    values = [row["width"], int(where[g]), *(a[own].astype("<i8").tobytes() for a in (ids, hashes, x)), least[own].astype("<f8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=names)

    return run


def _searcher(k: int):
    """Rows (ids, hashes, vectors of a block; queries sent to it), those of one block after the other."""

    def run(batches):
        import pyarrow as pa

        at, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                ids, _, x = _read(row)
                key = (row["width"], row["pivot"], row["split"])
                if key != at:
                    at, tree = key, cover_tree(x.astype(np.float64))
                q_ids, q_hashes, q = _read(row, "q_")
                found = search(q, q_ids, x, ids, k, np.frombuffer(row["q_least"], "<f8"), tree)
                if found:
                    n, who, score = zip(*found)
                    n = np.array(n)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[n]), pa.array(q_hashes[n]), pa.array(who, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "query_hash", "vec_id", "score"])

    return run


FOUND_SCHEMA = "query_id long, query_hash long, vec_id long, score long"


def _pivots(rows: DataFrame, blocks: int) -> dict[int, np.ndarray]:
    """Pivots of each width, farthest first, from a sample bounded in rows and bytes."""
    if blocks == 1:
        return {}
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    n = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, widest))))
    by_width: dict[int, list] = {}
    for (v,) in rows.orderBy("hash", "vec_id").select("v").limit(n).collect():
        by_width.setdefault(len(v), []).append(v)
    out = {}
    for width, found in by_width.items():
        if width:
            x = np.array(found, np.float64)
            out[width] = x[farthest_first(x, min(PIVOTS, blocks))[0]]
    return out


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query (vec_id divisible by `every`) its k best rows by integer inner product: query_id, rank, vec_id, score.

    Every other row is a candidate, ties go to the smaller vec_id, and a query with fewer candidates gets them all. Vectors of
    another width are no candidates. Rows that repeat a query's id aren't its candidates; repeated candidates count each. Rows of one query id with
    different vectors are queries of their own, each with its ranks. Rows without a sound vector take no part; no rows in, no rows out. Other columns play no part.
    """
    spark = df.sparkSession
    rows = stored(quantised(df, id_col, vector_col).withColumn("hash", F.xxhash64("v")), "vectors")
    width, key = int(spark.conf.get("spark.sql.shuffle.partitions")), ["width", "pivot", "split"]
    centers = _pivots(rows, max(1, -(-rows.count() // BLOCK)))
    pivots = spark.sparkContext.broadcast(centers)
    placed = stored(mapped(rows.select("vec_id", "v", "hash"), _placer(pivots), PLACED_SCHEMA), "placed")
    is_query = F.col("vec_id") % every == 0
    sizes = placed.groupBy("width", "pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("queries"), F.max("far").alias("radius"))
    sizes = settled(sizes.select("width", "pivot", F.ceil(F.col("n") / BLOCK).cast("int").alias("splits"), F.ceil(F.col("queries") / QUERY_BLOCK).cast("int").alias("q_splits"), "radius"))
    radius = {w: np.zeros(len(c)) for w, c in centers.items()}
    for r in sizes.where("pivot >= 0").collect():  # as many rows as there are pivots
        radius[r["width"]][r["pivot"]] = r["radius"]
    radii = spark.sparkContext.broadcast(radius)
    counts = sizes.select("width", "pivot", "splits", "q_splits")
    if counts.count() <= MOST_GROUPS:  # a row for each pivot, and for each width that has none
        counts = F.broadcast(counts)

    def blocked(part: DataFrame, splits: str) -> DataFrame:
        dealt = part.join(counts, ["width", "pivot"]).select("width", "pivot", F.pmod(F.xxhash64("vec_id", "hash"), F.col(splits)).cast("int").alias("split"), "vec_id", "hash", "v", "least")
        return stored(mapped(dealt.repartition(width, *key).sortWithinPartitions(*key), _blocker, BLOCK_SCHEMA), "blocks")

    lowest = F.lit(float("-inf"))
    candidates = blocked(placed.withColumn("least", lowest), "splits").drop("least")
    asked = placed.where(is_query).dropDuplicates(["vec_id", "hash", "v"])

    def met(queries: DataFrame, first: bool) -> DataFrame:
        """The k best that queries find in the blocks of the pivots that they are sent to, or in one block of the best pivot."""
        sent = mapped(queries, _sender(pivots, radii, first), SENT_SCHEMA)
        split = F.explode(F.sequence(F.lit(0), F.lit(0) if first else F.col("splits") - 1)).alias("split")
        to = sent.join(counts, ["width", "pivot"]).select(*sent.columns, split)
        both = candidates.join(to, key).select(*candidates.columns, *[c for c in sent.columns if c.startswith("q_")])
        found = mapped(both.repartition(width, *key, F.xxhash64("q_ids")).sortWithinPartitions(*key), _searcher(k), FOUND_SCHEMA)
        order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    begun = met(blocked(asked.withColumn("least", lowest), "q_splits"), True).where(F.col("rank") == k)
    least = begun.select(F.col("query_id").alias("vec_id"), F.col("query_hash").alias("hash"), F.col("score").cast("double").alias("least"))
    again = asked.join(least, ["vec_id", "hash"], "left").withColumn("least", F.coalesce("least", lowest))
    return met(blocked(again, "q_splits"), False).select("query_id", "rank", "vec_id", "score")
