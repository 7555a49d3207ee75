"""Bisecting k-means (cosine) over all vectors of a table: always the loosest leaf is split next.

Vectors are kept in whole multiples of 1 / UNIT and centres in multiples of 1 / FINE, so products (under 2^53) and sums
are exact and the leaves do not hang on the order of rows, on partitions or on which of two ways a leaf is split:

* Leaves of more than LOCAL vectors are split together in passes over the table. A pass gives, for each of them, the
  vector farthest from a point or the sum of one side; only these reach the driver. How a leaf parts hangs on its own
  vectors alone, so all leaves that may be next are split at once and the order is followed afterwards.
* A leaf of at most LOCAL vectors goes to one task, which splits it further to the end.
"""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.runtime import Scratch, slices

UNIT, FINE = 1 << 20, 1 << 24
#: Rounds of moving the two centres of a split; a leaf of fewer vectors is not split.
MOVES, LEAST_LEAF = 8, 4
#: Vectors of a leaf that one task splits to the end (with 133 numbers each: 70 MB).
LOCAL = 1 << 17
#: Vectors that are multiplied at once.
STEP = 8_192


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def whole(v: np.ndarray) -> np.ndarray:
    """Unit vectors in whole multiples of 1 / UNIT."""
    return np.rint(v * UNIT).astype(np.int32)


@dataclass(eq=False)
class Node:
    """Vectors of one leaf: their number and sum, the leaf's centre, how far they are from it together.

    parts: the two it was split into, () if it cannot be split, None if that is not known yet.
    """

    n: int
    total: np.ndarray | None
    centre: np.ndarray
    loose: float
    key: int = 0
    parts: tuple[Node, ...] | None = None


def _centre(total: np.ndarray) -> np.ndarray:
    return np.rint(_unit(total) * FINE)


def _node(n: int, total: np.ndarray, centre: np.ndarray) -> Node:
    return Node(n, total, centre, n - float(total @ centre) / (UNIT * FINE))


def _split(node: Node) -> Generator[tuple[str, np.ndarray | None], object, tuple[Node, ...]]:
    """The two parts of a node, or ().

    Asks for ("far", y): the vector with the least product with y; ("sum", y): number and sum of the vectors whose
    product with y is above 0. A split starts from two vectors far from each other.
    """
    if node.n < LEAST_LEAF:
        return ()
    a = yield "far", node.centre
    b = yield "far", a
    pair = b * (FINE // UNIT), a * (FINE // UNIT)
    n, total = yield "sum", pair[1] - pair[0]
    for _ in range(MOVES):
        if not 0 < n < node.n:
            return ()
        moved = _centre(node.total - total), _centre(total)
        if all(map(np.array_equal, moved, pair)):
            break
        pair = moved
        n, total = yield "sum", pair[1] - pair[0]
    if not 0 < n < node.n:
        return ()
    return _node(node.n - n, node.total - total, pair[0]), _node(n, total, pair[1])


def _grown(root: Node, leaves: int) -> tuple[list[Node], list[Node]]:
    """The leaves as far as splits are known, and the nodes whose split is needed to go on (with none it is done)."""
    out, wanted, loose = [root], [], [root.loose]
    while len(out) + len(wanted) < leaves and max(loose) > 1e-6:
        i = int(np.argmax(loose))
        if parts := out[i].parts:
            out[i] = parts[0]
            out.append(parts[1])
            loose[i] = parts[0].loose
            loose.append(parts[1].loose)
            continue
        if parts is None:
            wanted.append(out[i])
        loose[i] = 0.0
    return out, wanted


def _far(x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[int, int, bytes]:
    """Product, id and bytes of the vector with the least product with y; ties go to the smaller id, then bytes."""
    s = x.astype(np.float64) @ y
    at = np.flatnonzero(s == s.min())
    at = at[ids[at] == ids[at].min()]
    return int(s[at[0]]), int(ids[at[0]]), min({x[i].tobytes() for i in at})


def _on(x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    return x @ y > 0 if y is not None else np.ones(len(x), bool)


def _sum(x: np.ndarray, y: np.ndarray | None) -> tuple[int, np.ndarray]:
    """Number and sum of the vectors whose product with y is above 0 (of all without y)."""
    x = x.astype(np.float64)
    on = _on(x, y)
    return int(on.sum()), on.astype(np.float64) @ x


def _steps(a: int, z: int) -> Iterator[slice]:
    return (slice(i, min(i + STEP, z)) for i in range(a, z, STEP))


def grow(x: np.ndarray, ids: np.ndarray, root: Node, leaves: int) -> None:
    """Splits a node whose vectors are x, which are put into another order, until it has so many leaves."""

    def answer(kind: str, y: np.ndarray, a: int, z: int):
        if kind == "far":
            return np.frombuffer(min(_far(x[s], ids[s], y) for s in _steps(a, z))[2], np.int32).astype(np.float64)
        got = [_sum(x[s], y) for s in _steps(a, z)]
        return sum(n for n, _ in got), sum(t for _, t in got)

    out, ends, loose = [root], [(0, len(x))], [root.loose]
    while len(out) < leaves and max(loose) > 1e-6:
        i = int(np.argmax(loose))
        a, z = ends[i]
        todo = _split(out[i])
        try:
            asked = next(todo)
            while True:
                last = asked[1]
                asked = todo.send(answer(*asked, a, z))
        except StopIteration as e:
            out[i].parts = e.value
        if not out[i].parts:
            loose[i] = 0.0
            continue
        on = np.concatenate([_on(x[s].astype(np.float64), last) for s in _steps(a, z)])
        order = a + np.concatenate([np.flatnonzero(~on), np.flatnonzero(on)])
        x[a:z], ids[a:z] = x[order], ids[order]
        left, right = out[i].parts
        ends[i], loose[i] = (a, a + left.n), left.loose
        ends.append((a + left.n, z))
        loose.append(right.loose)
        out[i] = left
        out.append(right)


def bisected(v: np.ndarray, leaves: int) -> np.ndarray:
    """Centres of the leaves that unit vectors are split into. Leaves that cannot be split stay; no vectors, no leaves."""
    if not len(v):
        return np.zeros((0, v.shape[1]), np.float32)
    x = whole(v)
    n, total = _sum(x, None)
    root = _node(n, total, _centre(total))
    grow(x, np.arange(n), root, leaves)
    return _centres(root, leaves)


def _centres(root: Node, leaves: int) -> np.ndarray:
    return (np.stack([x.centre for x in _grown(root, leaves)[0]]) / FINE).astype(np.float32)


def raw(column: pa.Array, dtype: type) -> np.ndarray:
    """The numbers that the rows of a binary column without nulls hold, one row's after the other's."""
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype)
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """node, vectors, ids of a batch, node by node."""
    for b in slices(batches, "v"):
        if not b.num_rows:
            continue
        node, ids, x = b.column("node").to_numpy(), b.column("id").to_numpy(), raw(b.column("v"), np.int32).reshape(b.num_rows, -1)
        order = np.argsort(node, kind="stable")
        starts = np.flatnonzero(np.diff(node[order], prepend=node[order[0]] - 1))
        for a, z in zip(starts, [*starts[1:], len(node)]):
            at = order[a:z]
            yield int(node[at[0]]), x[at], ids[at]


def _rows(node: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    v = pa.Array.from_buffers(pa.binary(x.shape[1] * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(ids), v], names=["node", "id", "v"])


def _farthest(table: DataFrame, asked: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int, bytes]] = {}
        for k, x, ids in _groups(batches):
            got = _far(x, ids, asked[k])
            best[k] = min(best.get(k, got), got)
        if best:
            score, ids, v = zip(*best.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64()), pa.array(v, pa.binary())], names=["node", "score", "id", "v"])

    found = table.where(F.col("node").isin(list(asked))).mapInArrow(run, "node int, score bigint, id bigint, v binary")
    rows = found.groupBy("node").agg(F.min(F.struct("score", "id", "v")).alias("x")).select("node", "x.v").collect()
    return {r["node"]: np.frombuffer(r["v"], np.int32).astype(np.float64) for r in rows}


def _sums(table: DataFrame, asked: dict[int, np.ndarray | None], dims: int) -> dict[int, tuple[int, np.ndarray]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for k, x, _ in _groups(batches):
            n, total = _sum(x, asked[k])
            sums.setdefault(k, np.zeros(dims + 1))[:] += [*total, n]
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims + 1, k, np.int32)), pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array(s.astype(np.int64))], names=["node", "dim", "x"])

    found = table.where(F.col("node").isin(list(asked))).mapInArrow(run, "node int, dim int, x bigint")
    rows = found.groupBy("node", "dim").agg(F.sum("x").alias("x")).toPandas()
    out = {k: np.zeros(dims + 1) for k in asked}
    for k, own in rows.groupby("node"):
        out[k][own["dim"]] = own["x"]
    return {k: (int(s[-1]), s[:-1]) for k, s in out.items()}


def _split_in_passes(table: DataFrame, nodes: list[Node], dims: int) -> dict[int, np.ndarray]:
    """Sets the parts of the nodes; the last points by which the vectors of those that were split parted."""
    todo = {x.key: (x, _split(x)) for x in nodes}
    last: dict[int, np.ndarray] = {}
    answers: dict[int, object] = dict.fromkeys(todo)
    while answers:
        asked = {}
        for k, got in answers.items():
            try:
                kind, last[k] = asked[k] = todo[k][1].send(got)
            except StopIteration as e:
                todo[k][0].parts = e.value
        # all ask for the same kind: the first two steps of a split are farthest vectors, the others sums
        points = {k: y for k, (_, y) in asked.items()}
        answers = {} if not points else _farthest(table, points) if kind == "far" else _sums(table, points, dims)
    return {k: last[k] for k, (x, _) in todo.items() if x.parts}


def _split_in_tasks(table: DataFrame, nodes: list[Node], leaves: int) -> None:
    """Splits each node to the end in one task."""
    given = {x.key: Node(x.n, x.total, x.centre, x.loose) for x in nodes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(k: int) -> pa.RecordBatch:
            x, ids = (np.concatenate(p) for p in zip(*parts))
            parts.clear()
            grow(x, ids, given[k], leaves)
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(_packed(given[k]))], pa.binary())], names=["node", "tree"])

        at, parts = None, []
        for k, x, ids in _groups(batches):
            if at not in (None, k):
                yield grown(at)
            at = k
            parts.append((x, ids))
        if at is not None:
            yield grown(at)

    own = table.where(F.col("node").isin(list(given))).repartition(len(given), "node").sortWithinPartitions("node")
    trees = dict(own.mapInArrow(run, "node int, tree binary").toPandas().itertuples(index=False))
    for x in nodes:
        x.parts = _unpacked(pickle.loads(trees[x.key])).parts


def _packed(node: Node) -> list:
    """The nodes of a tree, parents before their parts: n, centre, loose, the place of the first part or 0, known."""
    nodes, out = [node], []
    for x in nodes:
        out.append((x.n, x.centre.astype(np.int32), x.loose, len(nodes) if x.parts else 0, x.parts is not None))
        nodes.extend(x.parts or ())
    return out


def _unpacked(rows: list) -> Node:
    nodes = [Node(n, None, centre.astype(np.float64), loose, -1) for n, centre, loose, _, _ in rows]
    for x, (_, _, _, first, known) in zip(nodes, rows):
        x.parts = (nodes[first], nodes[first + 1]) if first else () if known else None
    return nodes[0]


def centres(vectors: DataFrame, dims: int, leaves: int, scratch: Scratch) -> np.ndarray:
    """What `bisected` gives for all rows of vectors(id bigint, v binary: int32 numbers as of `whole`)."""
    table = vectors.select(F.lit(0).alias("node"), "id", "v")
    n, total = _sums(table, {0: None}, dims)[0]
    if not n:
        return np.zeros((0, dims), np.float32)
    root, last_key = _node(n, total, _centre(total)), 0
    while True:
        out, wanted = _grown(root, leaves)
        if not wanted:
            return _centres(root, leaves)
        if own := [x for x in wanted if x.n <= LOCAL]:
            _split_in_tasks(table, own, leaves)
        large = [x for x in wanted if x.n > LOCAL]
        routes = {}
        for k, y in _split_in_passes(table, large, dims).items():
            parts = next(x for x in large if x.key == k).parts
            for x in parts:
                last_key += 1
                x.key = last_key
            routes[k] = (y, parts[0].key, parts[1].key)
        if routes:
            # a leaf may still be split if that is not known: the vectors of all these go on
            kept = [x.key for x in out if x.parts is None]
            moved = scratch.save(table.where(F.col("node").isin([*routes, *kept])).mapInArrow(_routed(routes), "node int, id bigint, v binary"))
            scratch.drop(table)
            table = moved


def _routed(routes: dict[int, tuple[np.ndarray, int, int]]):
    """The rows, with those of nodes that were split in their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, x, ids in _groups(batches):
            if k in routes:
                y, left, right = routes[k]
                node = np.where(_on(x.astype(np.float64), y), right, left)
            else:
                node = np.full(len(x), k)
            yield _rows(node, ids, x)

    return run
