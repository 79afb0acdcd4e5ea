"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned so that leading dimensions hold most of the energy. Vectors of one label are cut
into blocks of neighbours along the leading dimensions, large ones, so that few are shipped; pairs of blocks whose boxes are
near each other are found by a range join on a grid. Blocks are compared tile by tile, unless the boxes that bound the
tiles' leading coordinates are too far apart. Within a tile, products are accumulated over leading dimensions first; what
the rest can add is bounded by the product of the suffix norms, and pairs that cannot reach the threshold any more are
dropped. Pairs that are left are decided by their cosine in double precision, from the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import cut
from plazaflow.llm.graph import components, least_of

THRESHOLD = 0.93
#: Numbers in a block of vectors that is shipped as a whole; vectors in a tile's side; leading coordinates in a block's box
#: and those whose grid deals out pairs of blocks; dimensions after which bounds are tried; candidates looked at together.
BLOCK_NUMBERS, TILE, BOX, GRID, STEPS, TOGETHER = 1 << 19, 1024, 4, 2, (8, 16, 32), 65_536
#: The rotation is fitted on at most so many vectors, and so many numbers: it only orders the work, results don't depend on it.
FITTED, FITTED_NUMBERS = 20_000, 4_000_000
#: Slack of bounds in single precision.
SLACK = 1e-4


def reach(threshold: float) -> float:
    """Distance beyond which unit vectors can't have the cosine."""
    return (max(2 - 2 * threshold, 0.0) + SLACK) ** 0.5


def rotation(classes: DataFrame) -> np.ndarray:
    """Principal axes (columns, most energy first) of unit vectors of the commonest dimension."""
    common = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return np.eye(1)
    most = max(1, min(FITTED, FITTED_NUMBERS // common.d))
    rows = classes.where(F.size("v") == common.d).orderBy("h1", "h2").limit(most).select("v").toPandas().v
    unit = _unit(np.array(rows.tolist(), np.float64))
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    unit = _unit(x)
    return (unit @ axes if axes.shape[0] == x.shape[1] else unit).astype(np.float32)


BLOCKS = "label bigint, dim int, block bigint, low array<double>, high array<double>, klass binary, copies binary, vectors binary"
SCHEMA = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("klass", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])


def blocks(classes: DataFrame, axes: np.ndarray, kind: np.dtype, threshold: float) -> DataFrame:
    """One row for up to BLOCK_NUMBERS numbers of a label's vectors of one dimension, neighbours in the grid of the leading
    axes. There are as many partitions as full blocks, and as cores: more would only cut blocks small."""
    total = classes.agg(F.sum(F.size("v"))).first()[0] or 0
    number = max(classes.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK_NUMBERS))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    def along(k: int):
        lead = F.array(*map(F.lit, axes[:, min(k, axes.shape[1] - 1)].tolist()))
        return F.aggregate(F.zip_with("v", lead, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / size

    cells = [F.floor(along(k) / F.lit(reach(threshold))).alias(f"c{k}") for k in range(GRID)]
    rows = classes.select("label", F.size("v").alias("dim"), *cells, along(0).alias("at"), "klass", "copies", "v")
    order = ["label", "dim", *(f"c{k}" for k in range(GRID)), "at"]
    rows = rows.repartitionByRange(number, *order).coalesce(number).sortWithinPartitions(*order, "klass").drop(*(f"c{k}" for k in range(GRID)), "at")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        of, count = None, 0

        def block() -> pa.RecordBatch:
            nonlocal number, count
            x = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False) for b in held]).astype(kind).reshape(count, -1)
            y = _turned(x.astype(np.float64), axes)[:, :BOX].astype(np.float64)
            numbers = [np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64).tobytes() for c in ("klass", "copies")]
            out = {"label": of[0], "dim": of[1], "block": number, "low": y.min(0).tolist(), "high": y.max(0).tolist(), "klass": numbers[0], "copies": numbers[1], "vectors": x.tobytes()}
            number, count = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_pylist([out], SCHEMA)

        for batch in source:
            label, dim = (batch.column(c).to_numpy() for c in ("label", "dim"))
            edge = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (dim[1:] != dim[:-1]), True]) if len(label) else []
            for a, b in zip(edge[:-1], edge[1:]):
                own = (int(label[a]), int(dim[a]))
                if held and own != of:
                    yield block()
                of, most = own, max(1, BLOCK_NUMBERS // own[1])
                while a < b:
                    take = min(b - a, most - count)
                    held.append(batch.slice(a, take))
                    a, count = a + take, count + take
                    if count == most:
                        yield block()
        if held:
            yield block()

    return rows.mapInArrow(run, BLOCKS)


def near_blocks(meta: DataFrame, threshold: float) -> DataFrame:
    """(block, block2): pairs of blocks of one label and dimension, the first number smaller, whose boxes are near enough.

    A range join on a grid over the first GRID leading coordinates: a block goes to the cells that its box covers, and, as
    the other side, to those that its box widened by the reach covers. A pair counts in one cell only, the least that both cover.
    """
    r = F.lit(reach(threshold))
    cell = lambda x: F.floor(x / r)
    at = lambda k, wide: (cell(F.get("low", F.lit(k)) - r * wide), cell(F.get("high", F.lit(k)) + r * wide))
    axes = lambda wide: [F.coalesce(x, F.lit(0).cast("bigint")).alias(f"{n}{k}") for k in range(GRID) for n, x in zip(("from", "to"), at(k, wide))]
    spread = lambda df: reduce(lambda d, k: d.withColumn(f"c{k}", F.explode(F.sequence(f"from{k}", f"to{k}"))), range(GRID), df)
    one = spread(meta.select("label", "dim", "block", "low", "high", *axes(0))).drop(*(f"to{k}" for k in range(GRID)))
    two = spread(meta.select("label", "dim", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"), *axes(1))).drop(*(f"to{k}" for k in range(GRID))).withColumnsRenamed({f"from{k}": f"since{k}" for k in range(GRID)})
    gap = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= r * r
    least = reduce(lambda a, b: a & b, (F.col(f"c{k}") == F.greatest(f"from{k}", f"since{k}") for k in range(GRID)))
    return one.join(two, ["label", "dim", *(f"c{k}" for k in range(GRID))]).where((F.col("block") < F.col("block2")) & least & near).select("block", "block2")


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b whose cosine reaches the threshold."""
    ya, yb = _turned(a, axes), _turned(b, axes)
    d = a.shape[1]
    steps = [s for s in STEPS if s < d] + [d]
    rest = lambda y, s: np.sqrt(np.maximum((y[:, s:].astype(np.float64) ** 2).sum(1), 0)).astype(np.float32)
    bound = ya[:, : steps[0]] @ yb[:, : steps[0]].T
    bound += np.outer(rest(ya, steps[0]), rest(yb, steps[0]))
    i, j = np.nonzero(bound >= threshold - SLACK)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ua, ub = _unit(a), _unit(b)
    for k in range(0, len(i), TOGETHER):
        p, q = i[k : k + TOGETHER], j[k : k + TOGETHER]
        sums = np.einsum("ij,ij->i", ya[p, : steps[0]], yb[q, : steps[0]])
        for low, high in zip(steps, steps[1:]):
            sums = sums + np.einsum("ij,ij->i", ya[p, low:high], yb[q, low:high])
            good = sums + rest(ya, high)[p] * rest(yb, high)[q] >= threshold - SLACK
            p, q, sums = p[good], q[good], sums[good]
        good = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
        found.append((p[good], q[good]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each place's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """linked() over tiles of TILE vectors; tiles whose boxes are too far apart are left out. With `same`, each pair once."""
    boxes = []
    for x in (a, b):
        y = _turned(x, axes)[:, :BOX]
        boxes.append([(y[k : k + TILE].min(0), y[k : k + TILE].max(0)) for k in range(0, len(x), TILE)])
    found = []
    for p, (low, high) in enumerate(boxes[0]):
        for q, (low2, high2) in enumerate(boxes[1]):
            if same and q < p or (np.maximum(np.maximum(low - high2, low2 - high), 0) ** 2).sum() > reach(threshold) ** 2:
                continue
            i, j = linked(a[p * TILE : (p + 1) * TILE], b[q * TILE : (q + 1) * TILE], axes, threshold)
            i, j = i + p * TILE, j + q * TILE
            found.append((i[i < j], j[i < j]) if same else (i, j))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def compare(tiles: DataFrame, axes: np.ndarray, kind: np.dtype, threshold: float, same: bool) -> DataFrame:
    """(node, links, other): number of a class's links within a pair of blocks (within one, with `same`), or, with `other`, one of the links that connect them."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                get = lambda name, what=np.int64: np.frombuffer(batch.column(name)[row].as_buffer(), what)  # noqa: E731,B023
                dim = batch.column("dim")[row].as_py()
                sides = ("",) if same else ("", "2")
                a, *b = (get("vectors" + n, kind).reshape(-1, dim).astype(np.float64) for n in sides)
                i, j = tile_links(a, b[0] if b else a, axes, threshold, same)
                if not len(i):
                    continue
                nodes, copies = (np.concatenate([get(name + n) for n in sides]) for name in ("klass", "copies"))
                j = j if same else j + len(a)
                count = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
                root = _roots(len(nodes), i, j)
                has, tied = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([nodes[has], nodes[tied]])),
                        pa.array(np.concatenate([count[has].astype(np.int64), np.zeros(len(tied), np.int64)])),
                        pa.array([*[None] * len(has), *nodes[root[tied]].tolist()], pa.int64()),
                    ],
                    ["node", "links", "other"],
                )

    return tiles.mapInArrow(run, "node bigint, links bigint, other bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, label, embedding).

    Vectors are compared only if their labels are equal and not null and they have equally many components. A vector that
    is null, empty, zero or holds a null or non-finite component links with nothing, nor does a row whose vec_id is null
    (its component_id is null). Equal vectors of one label are compared once, as a class, and count as many as they are.
    Rows that share an id and may link are one vertex as far as reach goes: what one of them reaches, all do. Other
    columns are ignored. Classes are told apart by 128 bits of hashes.
    """
    double = dict(vectors.dtypes)["embedding"] != "array<float>"
    kind = np.dtype(np.float64 if double else np.float32)
    base = vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0.0), F.lit(False))
    hashed = {"h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v", "label")}
    good = base.where(sound)
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumns(hashed | {"klass": F.monotonically_increasing_id()}))
    axes = rotation(classes)
    own = cut(blocks(classes, axes, kind, threshold))
    parts = own.select("block", "dim", "klass", "copies", "vectors")
    found = compare(parts, axes, kind, threshold, True)
    pairs = cut(near_blocks(own.select("label", "dim", "block", "low", "high"), threshold))
    if number := pairs.count():
        right = own.select(F.col("block").alias("block2"), *(F.col(c).alias(c + "2") for c in ("klass", "copies", "vectors")))
        found = found.unionByName(compare(pairs.join(parts, "block").join(right, "block2").coalesce(number), axes, kind, threshold, False))
    found = cut(found)
    rows = good.withColumns(hashed).select("vec_id", "h1", "h2")
    known = cut(rows.join(classes.select("h1", "h2", "klass"), ["h1", "h2"]).select("vec_id", "klass"))
    ties = known.groupBy("vec_id").agg(F.min("klass").alias("node"), F.max("klass").alias("most")).where("node < most")
    ties = known.join(ties, "vec_id").select("klass", "node")
    roots = components(found.where("other is not null").select("node", "other").unionByName(ties.toDF("node", "other")), "node", "other")
    none = F.lit(None).cast("bigint")
    facts = [
        classes.select("klass", "first", "copies", none.alias("links"), none.alias("root")),
        found.where("other is null").select("node", none, none, "links", none).toDF("klass", "first", "copies", "links", "root"),
        roots.select("node", none, none, none, "root").toDF("klass", "first", "copies", "links", "root"),
    ]
    each = reduce(DataFrame.unionByName, facts).groupBy("klass").agg(F.max("first").alias("first"), (F.coalesce(F.sum("links"), F.lit(0)) + F.max("copies") - 1).alias("n_links"), F.coalesce(F.max("root"), "klass").alias("root"))
    reached = least_of(cut(each), "root", "first", "component_id")
    joined = known.join(reached.select("klass", "n_links", "component_id"), "klass").select("vec_id", "n_links", "component_id")
    rest = base.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
