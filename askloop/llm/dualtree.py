"""Exact top-k search by inner product, with cover trees over queries and data.

A bounded sample of vectors gives the pivots of the top level; every vector goes to its nearest pivot's cell, and a cell is
cut into blocks of about ``BLOCK_ROWS`` rows, so a cell that holds a third of all rows is many blocks. Each block of data or
queries becomes one cover tree: a node has a centre and a covering radius, its children are a farthest-first net of its
points. Queries first meet one block of their own cell, which gives every query a kth score. A block of queries then visits
only cells, and in them pairs of nodes, whose bound qc.dc + |qc| rd + |dc| rq + rq rd reaches the worst kth score of the
queries below the node. Scores are exact integers, so the result does not depend on pivots, blocks or order.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows without an id.
Vectors meet only vectors of their own length. A row repeated whole counts once; rows that share an id but not their vector
are separate rows, and none of them is a candidate of a query with that id. Equal scores go to the smaller id. With fewer
than k candidates all are returned. Other columns are not read. Components are taken to fit 52 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 24
BLOCK_ROWS = 8_192
QUERY_ROWS = 512
LEAF = 96
FAN = 24
NO_SCORE = -(1 << 62)
BLOCK = "dim int, cell int, block int, n int, ids binary, vectors binary, nodes binary, spans binary"
PAIR = "query_dim int, query_cell int, query_block int, query_n int, query_ids binary, query_vectors binary, query_nodes binary, query_spans binary"
FOUND = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def integers(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, vec): floor(scale * component) of the vectors that take part."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    return kept.select(F.col(vec_id).cast("bigint").alias("vec_id"), whole.alias("vec")).distinct()


class Tree:
    """Cover tree of some vectors. Node rows: centre, radius; spans: start, end, first child, children. Points are reordered."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.centres, self.radii, self.spans = [], [], []
        self.points = points
        self._add(0, len(points))
        at = 0
        while at < len(self.spans):
            self._split(at)
            at += 1

    def _add(self, start: int, end: int, centre: int | None = None) -> None:
        own = self.points[self.order[start:end]]
        middle = own[0] if centre is None else self.points[centre]
        far = np.sqrt(((own - middle) ** 2).sum(axis=1).max())
        self.centres.append(middle)
        self.radii.append(far * (1 + 1e-9))
        self.spans.append([start, end, 0, 0])

    def _split(self, node: int) -> None:
        start, end, _, _ = self.spans[node]
        if end - start <= LEAF or self.radii[node] == 0:
            return
        own = self.order[start:end]
        points = self.points[own]
        nearest = np.full(len(own), np.inf)
        child = np.zeros(len(own), np.int64)
        centres = []
        while len(centres) < FAN:
            far = 0 if not centres else int(nearest.argmax())
            if centres and nearest[far] == 0:
                break
            d = ((points - points[far]) ** 2).sum(axis=1)
            closer = d < nearest
            nearest[closer], child[closer] = d[closer], len(centres)
            centres.append(own[far])
        by_child = np.argsort(child, kind="stable")
        self.order[start:end] = own[by_child]
        cuts = start + np.searchsorted(child[by_child], np.arange(len(centres) + 1))
        self.spans[node][2:] = [len(self.spans), len(centres)]
        for c, centre in enumerate(centres):
            self._add(int(cuts[c]), int(cuts[c + 1]), int(centre))


def pack_block(ids: np.ndarray, vectors: np.ndarray) -> dict[str, bytes]:
    tree = Tree(vectors.astype(np.float64))
    nodes = np.column_stack([np.array(tree.centres).reshape(len(tree.radii), -1), tree.radii])
    return {
        "ids": ids[tree.order].tobytes(),
        "vectors": np.ascontiguousarray(vectors[tree.order]).tobytes(),
        "nodes": nodes.tobytes(),
        "spans": np.array(tree.spans, np.int64).tobytes(),
    }


class Block:
    """A packed block, read back."""

    def __init__(self, n: int, dim: int, ids: bytes, vectors: bytes, nodes: bytes, spans: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(n, dim)
        nodes = np.frombuffer(nodes, np.float64).reshape(-1, dim + 1)
        self.centres, self.radii = nodes[:, :-1], nodes[:, -1]
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.spans = np.frombuffer(spans, np.int64).reshape(-1, 4)
        top = float(np.abs(self.vectors).max(initial=0))
        self.exact = top * top * max(dim, 1) < 2**52
        self.numbers = self.vectors.astype(np.float64) if self.exact else self.vectors


class Best:
    """The k best (score, id) of each query so far; unfilled places have no id."""

    def __init__(self, queries: Block, k: int, least: np.ndarray | None = None):
        n = len(queries.ids)
        self.k, self.queries = k, queries
        self.scores = np.full((n, k), NO_SCORE)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.least = np.full(n, NO_SCORE) if least is None else least

    def worst(self, a: int, b: int) -> int:
        return int(np.maximum(self.scores[a:b, -1], self.least[a:b]).min())

    def offer(self, a: int, b: int, data: Block, c: int, d: int) -> None:
        queries = self.queries
        if queries.exact and data.exact:
            scores = (queries.numbers[a:b] @ data.numbers[c:d].T).astype(np.int64)
        else:
            scores = queries.vectors[a:b] @ data.vectors[c:d].T
        floor = np.maximum(self.scores[a:b, -1], self.least[a:b])[:, None]
        scores[queries.ids[a:b, None] == data.ids[None, c:d]] = NO_SCORE
        rows = np.flatnonzero((scores >= floor).any(axis=1))
        for r in rows.tolist():
            at = np.flatnonzero((scores[r] >= floor[r]) & (data.ids[c:d] != queries.ids[a + r]))
            s = np.concatenate([self.scores[a + r], scores[r, at]])
            i = np.concatenate([self.ids[a + r], data.ids[c:d][at]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[a + r], self.ids[a + r] = s[order], i[order]


def search(queries: Block, data: Block, best: Best) -> None:
    """Offer every pair of a query and a row that can matter, best bounds first."""

    def bound(q: int, d: int) -> float:
        rq, rd = queries.radii[q], data.radii[d]
        full = float(queries.centres[q] @ data.centres[d]) + queries.norms[q] * rd + data.norms[d] * rq + rq * rd
        return full + 1e-9 * abs(full) + 1e-6

    agenda = [(-bound(0, 0), 0, 0)]
    while agenda:
        high, q, d = heapq.heappop(agenda)
        qa, qb, q_first, q_kids = queries.spans[q].tolist()
        da, db, d_first, d_kids = data.spans[d].tolist()
        if -high < best.worst(qa, qb):
            continue
        if not q_kids and not d_kids:
            best.offer(qa, qb, data, da, db)
        elif q_kids and (not d_kids or queries.radii[q] > data.radii[d]):
            for x in range(q_first, q_first + q_kids):
                heapq.heappush(agenda, (-bound(x, d), x, d))
        else:
            for x in range(d_first, d_first + d_kids):
                heapq.heappush(agenda, (-bound(q, x), q, x))


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _assigned(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(dim, cell, far, vec_id, vec): each vector with its nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                v = _vectors(own.column(1), dim).astype(np.float64)
                middles = pivots.get(dim, np.zeros((1, dim)))
                d = (v**2).sum(axis=1)[:, None] - 2 * v @ middles.T + (middles**2).sum(axis=1)[None]
                cell = d.argmin(axis=1)
                far = np.sqrt(((v - middles[cell]) ** 2).sum(axis=1))
                yield pa.record_batch({
                    "dim": pa.array([dim] * len(own), pa.int32()), "cell": pa.array(cell.astype(np.int32)),
                    "far": pa.array(far), "vec_id": own.column(0), "vec": own.column(1),
                })

    return rows.mapInArrow(run, "dim int, cell int, far double, vec_id bigint, vec array<bigint>")


def _blocks(rows: DataFrame, sizes: dict[tuple[int, int], int], block_rows: int) -> DataFrame:
    """One packed row for each block of at most about ``block_rows`` rows of a cell."""
    blocks = F.lit(1)
    for (dim, cell), n in sizes.items():
        if n > block_rows:
            blocks = F.when((F.col("dim") == dim) & (F.col("cell") == cell), -(-n // block_rows)).otherwise(blocks)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        dim, cell, block = (x.as_py() for x in key)
        ids = table.column("vec_id").to_numpy()
        order = np.lexsort((ids,))
        packed = pack_block(ids[order], _vectors(table.column("vec"), dim)[order])
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "block": pa.array([block], pa.int32()),
            "n": pa.array([len(ids)], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in packed.items()},
        })

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), blocks).cast("int")).drop("far")
    return dealt.groupBy("dim", "cell", "block").applyInArrow(pack, BLOCK)


def _read(row: dict, prefix: str) -> Block:
    return Block(*(row[prefix + c] for c in ("n", "dim", "ids", "vectors", "nodes", "spans")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _found(queries: Block, best: Best) -> dict[str, pa.Array]:
    row, place = np.nonzero(best.ids < np.iinfo(np.int64).max)
    # Queries that share an id keep apart by their vectors.
    keys = np.array([int.from_bytes(blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in queries.vectors], np.int64)
    return {
        "query_id": pa.array(queries.ids[row]), "query_key": pa.array(keys[row]),
        "vec_id": pa.array(best.ids[row, place]), "score": pa.array(best.scores[row, place]),
    }


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``df`` with the highest inner product for each query row."""
    rows = integers(df, vec_id, vector, scale)
    sample = rows.orderBy(F.xxhash64("vec_id", "vec")).limit(PIVOTS * 8).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.vec), []).append(r.vec)
    pivots = {dim: _net(np.array(v, np.float64).reshape(len(v), dim)) for dim, v in by_dim.items()}
    placed = _assigned(rows, pivots)
    asking = _assigned(rows.filter(is_query), pivots)
    cells = {(r.dim, r.cell): (r.n, r.far) for r in placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    asked = {(r.dim, r.cell): r.n for r in asking.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    sizes = {key: n for key, (n, _) in cells.items()}
    counts = {key: -(-n // BLOCK_ROWS) for key, n in sizes.items()}
    data = _blocks(placed, sizes, BLOCK_ROWS)
    asks = _blocks(asking, asked, QUERY_ROWS)
    asks = asks.select(*[F.col(c).alias(f"query_{c}") for c in asks.columns])

    def visits(home: bool, least: bool):
        """Rows of query blocks with the (cell, block) of data that each has to meet."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                dim, own = row["query_dim"], (row["query_dim"], row["query_cell"])
                first = row["query_block"] % counts[own]
                if home:
                    met = [(own[1], first)]
                else:
                    q = _read(row, "query_")
                    worst = np.frombuffer(row["least"], np.int64)
                    middles = pivots.get(dim, np.zeros((1, dim)))
                    met = []
                    norms = np.sqrt((q.vectors.astype(np.float64) ** 2).sum(axis=1))
                    for (d, cell), (_, far) in cells.items():
                        if d == dim:
                            bound = q.vectors @ middles[cell] + norms * far * (1 + 1e-9)
                            if (bound + 1e-9 * np.abs(bound) + 1e-6 >= worst).any():
                                met += [(cell, b) for b in range(counts[d, cell]) if (cell, b) != (own[1], first)]
                names = [f for f in row if f.startswith("query_") or f == "least"]
                for cell, block in met:
                    yield pa.RecordBatch.from_pylist([{"dim": dim, "cell": cell, "block": block, **{f: row[f] for f in names}}], schema=_schema(least))

        return run

    def meet(with_least: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                q, d = _read(row, "query_"), _read(row, "")
                best = Best(q, k, np.frombuffer(row["least"], np.int64) if with_least else None)
                search(q, d, best)
                if with_least:
                    yield pa.record_batch(_found(q, best))
                else:
                    out = {f: row[f] for f in row if f.startswith("query_")}
                    found = {f: v.to_numpy().tobytes() for f, v in _found(q, best).items()}
                    yield pa.RecordBatch.from_pylist([{**out, "least": best.scores[:, -1].tobytes(), "home": found}], schema=_home_schema())

        return run

    key = ["dim", "cell", "block"]
    first = asks.mapInArrow(visits(True, False), f"dim int, cell int, block int, {PAIR}").join(data, key)
    home = first.mapInArrow(meet(False), f"{PAIR}, least binary, home struct<query_id: binary, query_key: binary, vec_id: binary, score: binary>")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch({f: pa.array(np.frombuffer(v, np.int64)) for f, v in row["home"].items()})

    rest = home.drop("home").mapInArrow(visits(False, True), f"dim int, cell int, block int, {PAIR}, least binary").join(data, key)
    found = home.select("home").mapInArrow(unpack, FOUND).unionAll(rest.mapInArrow(meet(True), FOUND))
    order = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fields(text: str) -> list[pa.Field]:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return [pa.field(n, kinds[t]) for n, t in (f.split() for f in text.split(", "))]


def _schema(least: bool) -> pa.Schema:
    return pa.schema(_fields("dim int, cell int, block int, " + PAIR + (", least binary" if least else "")))


def _home_schema() -> pa.Schema:
    names = ("query_id", "query_key", "vec_id", "score")
    return pa.schema([*_fields(PAIR + ", least binary"), pa.field("home", pa.struct([(n, pa.binary()) for n in names]))])


def _net(points: np.ndarray) -> np.ndarray:
    """At most ``PIVOTS`` points, farthest first."""
    chosen = [0]
    nearest = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < PIVOTS and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]
