"""Exact top-k search by inner product: a KD-tree a shard, searched best first by box bounds.

Vectors are dealt out by a hash of their row number into shards of even size.  A task splits its shard
at medians of the widest dimension down to leaves, keeps the tight box of each node, and writes the
tree as one row: the index, which stays in the shared folder while the queries run.

No point of a box can score more with a query than the sum over dimensions of the larger product
with the box's two ends.  A search takes the node of the greatest such bound first and ends when no
bound can still beat the k-th result.  The k-th score is handed on: each query searches one shard
first, and the others only with what that shard's k-th result leaves possible.  An id's order among equal
scores counts too (each node knows its smallest id), so that a large group of equal vectors is
searched only as far as its smallest ids.

Queries go through the shards in tiles of bounded size; a tree is copied once for every TILES_A_COPY
tiles.  Work grows with queries times shards unless bounds cut it: exact search in many dimensions
looks at nearly all leaves.
"""

from __future__ import annotations

import fractions
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.llm.shared import written

LEAF_ROWS = 256
#: A shard's rows: a 64th of all vectors within these bounds, and SHARD_BYTES at most.
SHARD_ROWS = (4096, 65_536)
SHARD_BYTES = 16 << 20
#: Queries of a tile, and bytes of their vectors at most.
TILE_ROWS = 512
TILE_BYTES = 4 << 20
TILES_A_COPY = 64
#: Stands for a null id inside tasks: it comes last.
NO_ID = (1 << 63) - 1

TREE = "dim int, shard int, rows binary, ids binary, vectors binary, low binary, high binary, least binary, bounds binary, lower binary, upper binary"
TILE = "dim int, home int, tile int, rows binary, ids binary, vectors binary"
FOUND = "dim int, home int, tile int, query long, query_id long, vec_id long, score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """floor(1024 * x) of each component as whole numbers: int64, or Python's where those don't fit."""
    x = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    if x.size and np.abs(x).max() >= 2.0**52:  # such numbers are whole or nearly: no step of floats could overflow here
        return np.array([[fractions.Fraction(v) * 1024 // 1 for v in row] for row in x.tolist()], object)
    return np.floor(1024 * x).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them; numbers beyond 64 bits as text."""
    if x.dtype == object:
        return b"t" + ",".join(map(str, x.ravel())).encode()
    for kind in (np.int16, np.int32):
        if not x.size or np.abs(x).max() <= np.iinfo(kind).max:
            return kind().dtype.char.encode() + x.astype(kind).tobytes()
    return b"l" + x.astype(np.int64).tobytes()


def _unpacked(b: bytes, dim: int, n: int) -> np.ndarray:
    if not dim:
        return np.zeros((n, 0), np.int64)
    if b[:1] == b"t":
        return np.array([int(v) for v in b[1:].decode().split(",")], object).reshape(n, dim)
    return np.frombuffer(b, b[:1].decode(), offset=1).astype(np.int64).reshape(n, dim)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _sorted(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The order by first and then second, of any kind of numbers."""
    order = np.argsort(second, kind="stable")
    return order[np.argsort(first[order], kind="stable")]


def build(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """A KD-tree in arrays: points in the order of its leaves; nodes with their range, children (-1: a leaf), box and smallest id."""
    order = np.arange(len(x))
    bounds, lower, upper = [(0, len(x))], [-1], [-1]
    at = 0
    while at < len(bounds):
        first, last = bounds[at]
        if last - first > LEAF_ROWS:
            own = order[first:last]
            points = x[own]
            widest = np.argmax(points.max(axis=0) - points.min(axis=0)) if x.shape[1] else 0
            half = len(own) // 2
            # Points that are equal in the widest dimension go by id: equal vectors are parted into smaller and larger ids.
            order[first:last] = own[_sorted(points[:, widest] if x.shape[1] else np.zeros(len(own)), ids[own])]
            lower[at], upper[at] = len(bounds), len(bounds) + 1
            bounds += [(first, first + half), (first + half, last)]
            lower += [-1, -1]
            upper += [-1, -1]
        at += 1
    x, ids = x[order], ids[order]
    low, high = (np.array([f(x[a:b], axis=0) for a, b in bounds]).reshape(len(bounds), x.shape[1]) for f in (np.min, np.max))
    return {"rows": rows[order], "ids": ids, "vectors": x, "low": low, "high": high, "least": np.array([ids[a:b].min() for a, b in bounds]), "bounds": np.array(bounds), "lower": np.array(lower), "upper": np.array(upper)}


def _tree_row(key: tuple, table: pa.Table) -> pa.Table:
    dim, shard = key[0].as_py(), key[1].as_py()
    tree = build(_ids(table["row"]), _ids(table["vec_id"]), _matrix(table["vector"], dim))
    packed = {k: _packed(v) if k in ("vectors", "low", "high") else v.astype(np.int64).tobytes() for k, v in tree.items()}
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32())} | {k: pa.array([packed[k]], pa.binary()) for k in ("rows", "ids", "vectors", "low", "high", "least", "bounds", "lower", "upper")})


def _tile_row(key: tuple, table: pa.Table) -> pa.Table:
    dim, home, tile = (v.as_py() for v in key)
    packed = {"rows": _ids(table["row"]).tobytes(), "ids": _ids(table["vec_id"]).tobytes(), "vectors": _packed(_matrix(table["vector"], dim))}
    return pa.table({c: pa.array([v], pa.int32()) for c, v in (("dim", dim), ("home", home), ("tile", tile))} | {c: pa.array([v], pa.binary()) for c, v in packed.items()})


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """x in the quickest kind of number in which no score of at most that size is rounded."""
    return x.astype(np.float64) if most < 1 << 53 else x.astype(np.int64) if most < 1 << 62 else x.astype(object)


def _within(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, LEAST, MOST) if scores.dtype == object else scores


def search(tree: dict[str, np.ndarray], query: np.ndarray, bound: np.ndarray, own_row: int, k: int, worst: tuple[int, int]) -> list[tuple[int, int]]:
    """The at most k best (score, id) of a tree that are no worse than `worst`; bound has each node's greatest possible score.

    A result is better by score, then by smaller id.  The query's own row is left out.
    """
    scores, ids = np.zeros(0, bound.dtype), np.zeros(0, np.int64)
    floor, floor_id = worst
    heap = [(-bound[0], 0)]
    while heap and -heap[0][0] >= floor:
        most, node = heapq.heappop(heap)
        if -most == floor and tree["least"][node] > floor_id:
            continue
        if tree["lower"][node] >= 0:
            for child in (tree["lower"][node], tree["upper"][node]):
                if bound[child] >= floor:
                    heapq.heappush(heap, (-bound[child], child))
            continue
        a, b = tree["bounds"][node]
        points = _within(tree["vectors"][a:b] @ query)
        near = np.flatnonzero(points >= floor)
        near = near[tree["rows"][a:b][near] != own_row]
        if len(near):
            scores, ids = np.concatenate([scores, points[near]]), np.concatenate([ids, tree["ids"][a:b][near]])
            best = _sorted(-scores, ids)[:k]
            scores, ids = scores[best], ids[best]
            if len(scores) == k and (-scores[-1], ids[-1]) < (-floor, floor_id):
                floor, floor_id = scores[-1], ids[-1]
    return [(int(s), int(i)) for s, i in zip(scores, ids) if (-s, i) <= (-worst[0], worst[1])]


def _searched(k: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a tile with a tree; all its queries are searched in that tree, down to their k-th results so far."""
        at = tree = None
        for batch in batches:
            for row in range(len(batch)):
                r = {c: batch[c][row] for c in batch.schema.names}
                ints = {c: np.frombuffer(v.as_buffer(), np.int64) for c, v in r.items() if pa.types.is_binary(v.type) and "vectors" not in c and c not in ("low", "high")}
                dim = r["dim"].as_py()
                if at != (dim, r["shard"].as_py()):
                    at, nodes = (dim, r["shard"].as_py()), len(ints["least"])
                    tree = {c: ints[c] for c in ("rows", "ids", "least", "lower", "upper")} | {"bounds": ints["bounds"].reshape(-1, 2)}
                    tree |= {c: _unpacked(r[c].as_buffer().to_pybytes(), dim, n) for c, n in (("vectors", len(ints["rows"])), ("low", nodes), ("high", nodes))}
                yield from _of_tile(tree, r, ints, dim, k)

    return of_batches


def _of_tile(tree: dict, r: dict, ints: dict, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    rows, ids, floor, floor_id = (ints[f"q_{c}"] for c in ("rows", "ids", "floor", "floor_id"))
    q = _unpacked(r["q_vectors"].as_buffer().to_pybytes(), dim, len(rows))
    reach = max(abs(int(tree["low"].min())), abs(int(tree["high"].max())), 1) * max(int(np.abs(q).max()), 1) * dim if dim else 0
    q, low, high = (_exact(v, reach) for v in (q, tree["low"], tree["high"]))
    own = {**tree, "vectors": _exact(tree["vectors"], reach)}
    bound = _within(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)
    out = [(i, s, v) for i in range(len(rows)) for s, v in search(own, q[i], bound[i], int(rows[i]), k, (int(floor[i]), int(floor_id[i])))]
    if out:
        which, score, found = map(list, zip(*out))
        null = lambda v: pa.array(v, pa.int64(), mask=np.asarray(v) == NO_ID)
        key = {c: pa.array([r[c].as_py()] * len(out), pa.int32()) for c in ("dim", "home", "tile")}
        yield pa.RecordBatch.from_pydict(key | {"query": pa.array(rows[which]), "query_id": null(ids[which]), "vec_id": null(found), "score": pa.array(score, pa.int64())})


def _floors(k: int):
    def with_floor(key: tuple, tile: pa.Table, found: pa.Table) -> pa.Table:
        """The tile with each query's k-th result so far, or what is worse than any result."""
        rows = np.frombuffer(tile["rows"][0].as_buffer(), np.int64)
        query, score, ids = (_ids(found[c]) for c in ("query", "score", "vec_id"))
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(~score[order], kind="stable")]  # ~s falls as s rises, and has no overflow
        order = order[np.argsort(query[order], kind="stable")]
        query, score, ids = query[order], score[order], ids[order]
        floor, floor_id = np.full(len(rows), LEAST), np.full(len(rows), NO_ID)
        last = np.searchsorted(query, rows, "left") + k - 1
        full = np.flatnonzero(last < len(query))
        full = full[query[last[full]] == rows[full]]
        floor[full], floor_id[full] = score[last[full]], ids[last[full]]
        return tile.append_column("floor", pa.array([floor.tobytes()], pa.binary())).append_column("floor_id", pa.array([floor_id.tobytes()], pa.binary()))

    return with_floor


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest inner product with each row that `queries` holds for.

    Components count as floor(1024 * x); scores are whole numbers.  A query's own row is no candidate;
    other rows are, those with the query's id or vector too.  Equal scores go by smaller id, a null id
    last.  Rows with a null vector, or a null or non-finite component, take no part; vectors of
    different lengths are never compared, and empty ones score 0.  A query row without any candidate
    has no result; of query rows with the same id each has its own ranks.  Scores beyond 64 bits
    count as the nearest number of 64 bits.  An empty table gives an empty result.  Other columns of
    vectors, whatever their names, are only read by `queries`, the condition that says which rows ask.
    """
    v = F.col(f"`{vector_col}`")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = vectors.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(plain.withColumn("row", F.monotonically_increasing_id()))
    # One row for each length of vector.
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"))
    wide = F.greatest(F.lit(1), F.col("dim")) * 8
    a_shard = F.greatest(F.lit(LEAF_ROWS), F.least(F.greatest(F.lit(SHARD_ROWS[0]), F.col("n") / 64), F.lit(SHARD_ROWS[1]), F.lit(SHARD_BYTES) / wide))
    a_tile = F.greatest(F.lit(1), F.least(F.lit(TILE_ROWS), F.lit(TILE_BYTES) / wide))
    sizes = sizes.select("dim", F.ceil(F.col("n") / a_shard).cast("int").alias("shards"), F.col("asking"), a_tile.alias("a_tile"))
    # Tiles of the queries at home in one shard.
    sizes = sizes.select("dim", "shards", F.greatest(F.lit(1), F.ceil(F.col("asking") / F.col("shards") / F.col("a_tile"))).cast("int").alias("tiles"))
    sizes = written(sizes)
    dealt = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))

    trees = written(dealt.select("dim", "shard", "row", "vec_id", "vector").groupBy("dim", "shard").applyInArrow(_tree_row, TREE))
    asking = dealt.where("asks").withColumn("tile", F.pmod(F.xxhash64("row", F.lit(1)), F.col("tiles")).cast("int")).withColumnRenamed("shard", "home")
    tiles = written(asking.select("dim", "home", "tile", "row", "vec_id", "vector").groupBy("dim", "home", "tile").applyInArrow(_tile_row, TILE))
    none = tiles.withColumn("floor", F.unhex(F.repeat(F.lit("0000000000000080"), (F.length("rows") / 8).cast("int")))).withColumn("floor_id", F.unhex(F.repeat(F.lit("ffffffffffffff7f"), (F.length("rows") / 8).cast("int"))))

    def asked(tiles: DataFrame) -> DataFrame:
        return tiles.select("dim", "home", "tile", *(F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "vectors", "floor", "floor_id")))

    at_home = written(asked(none).withColumn("shard", F.col("home")).join(trees, ["dim", "shard"]).mapInArrow(_searched(k), FOUND))
    tile_key = ["dim", "home", "tile"]
    bounded = written(tiles.groupBy(*tile_key).cogroup(at_home.groupBy(*tile_key)).applyInArrow(_floors(k), f"{TILE}, floor binary, floor_id binary"))
    # Every other shard: a tree is there once for so many tiles, which meet it in one task.
    copy = F.floor((F.col("home") * F.col("tiles") + F.col("tile")) / TILES_A_COPY).cast("int").alias("copy")
    spread = asked(bounded).join(sizes, "dim").select("*", copy, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).where("shard <> home").drop("shards", "tiles")
    copies = sizes.select("dim", F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") * F.col("tiles") - 1) / TILES_A_COPY).cast("int"))).alias("copy"))
    rest = spread.join(trees.join(copies, "dim"), ["dim", "shard", "copy"]).mapInArrow(_searched(k), FOUND)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = at_home.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
