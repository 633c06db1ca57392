"""Near duplicates among embeddings: spherical k-means cells, and packs of cells compared in pairs.

Vectors are moved once, into packs of neighbouring cells that are written as a table. A pair of
packs is a row of that table joined to itself, so no vector is written again for the cells or
packs it is compared with; what is shuffled after that are keys, counts and links.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import give_back_memory, pick, staged
from pairloom.llm.components import components, local_roots

#: Most rows and bytes of a pack. A table that makes fewer than PACKS of these gets smaller ones, of SMALL_BLOCK rows or more.
BLOCK, PACK_BYTES, SMALL_BLOCK, PACKS = 32768, 4 << 20, 1024, 24
#: Vectors the centroids are fitted on (a bounded sample, by hash), and most cells.
FIT_ROWS, MOST_CELLS = 8192, 1024
#: Rows and columns of a product, opened packs that a task remembers, and links it holds before it folds them.
TILE_ROWS, TILE_COLUMNS, OPEN_PACKS, MOST_EDGES = 512, 4096, 5, 1 << 20
_PACK = "start long, n int, cells binary, first binary, second binary, copies binary, data binary"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def spherical_kmeans(unit: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids; each is the direction of the sum of the vectors nearest to it."""
    rng = np.random.default_rng(seed)
    centroids = unit[rng.choice(len(unit), size=min(cells, len(unit)), replace=False)]
    for _ in range(rounds):
        nearest = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def _valid(dimension: int | None = None) -> Column:
    v = F.col("v")
    # NaN is above infinity, and nulls are passed over
    low, high = F.array_min(v), F.array_max(v)
    usable = v.isNotNull() & (low > -math.inf) & (high < math.inf) & ((low != 0) | (high != 0)) & F.forall(v, lambda x: x.isNotNull())
    return usable if dimension is None else usable & (F.size(v) == dimension)


def _key(seed: int) -> Column:
    """A hash of the vector; two seeds make a key of 128 bits. Zero and minus zero are equal."""
    return F.xxhash64(F.lit(seed), F.col("v"))


def _slack(dimension: int) -> float:
    """Twice the most that a product of two unit vectors in single precision can be off."""
    return (dimension + 16) * 2.0**-23


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cell of each vector. Equal vectors get the same one in whatever batch they come: near
    ties in single precision are decided by sums that are rounded once."""
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    near = (vectors / length[:, None]).astype(np.float32) @ centroids.astype(np.float32).T
    cell = near.argmax(axis=1)
    close = near >= near[np.arange(len(cell)), cell][:, None] - 2 * _slack(vectors.shape[1])
    for i in np.flatnonzero(close.sum(axis=1) > 1).tolist():
        rivals = np.flatnonzero(close[i])
        sums = [math.fsum(x) for x in vectors[i].astype(np.float64) * centroids[rivals]]
        cell[i] = rivals[int(np.argmax(sums))]
    return cell


def _scaled(values: pa.Array, dimension: int) -> np.ndarray:
    """Rows whose largest component is between a half and one; the powers of two leave them exact."""
    vectors = np.asarray(values.flatten()).reshape(-1, dimension)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _blob(values: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * values.shape[1]
    ends = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _folds(first: np.ndarray, second: np.ndarray, copies: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each key, ordered by ``before`` and key, and the copies it stands for."""
    order = np.lexsort((second, first, *before))
    a, b = first[order], second[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return order[new], np.add.reduceat(copies[order], new)


def _dealt(centroids: np.ndarray, base: np.ndarray, parts: np.ndarray):
    """Vectors by pack, with equal ones of a batch folded."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(name)) for name in ("first", "second")]
            at, copies = _folds(*keys, np.ones(batch.num_rows, np.int64))
            vectors = _scaled(batch.column("v"), centroids.shape[1])[at]
            cell = _nearest(vectors, centroids)
            first, second = (key[at] for key in keys)
            pack = base[cell] + np.mod(first, parts[cell])
            columns = [pa.array(pack.astype(np.int32)), pa.array(cell.astype(np.int32)), *map(pa.array, (first, second, copies)), _blob(vectors)]
            yield pa.RecordBatch.from_arrays(columns, ["pack", "cell", "first", "second", "copies", "data"])
        give_back_memory()

    return deal


def _packed(block: int):
    """The vectors of a pack, equal ones folded, by cell: one row, or more if it has over ``block``."""

    def pack(table: pa.Table) -> pa.Table:
        cells, first, second, copies = (table.column(name).to_numpy() for name in ("cell", "first", "second", "copies"))
        at, copies = _folds(first, second, copies, cells)
        data = table.column("data").combine_chunks().take(pa.array(at)).cast(pa.binary()).to_pylist()
        start = int(table.column("pack")[0].as_py()) << 32
        rows = []
        for part in np.array_split(np.arange(len(at)), -(-len(at) // block)):
            x, y = int(part[0]), int(part[-1]) + 1
            own = at[x:y]
            blobs = [values.tobytes() for values in (cells[own].astype(np.int32), first[own], second[own], copies[x:y])]
            rows.append((start + x, y - x, *blobs, b"".join(data[x:y])))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        names = ["start", "n", "cells", "first", "second", "copies", "data"]
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    return pack


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct vectors of packs: number, key and copies."""
    for batch in batches:
        for row in batch.to_pylist():
            number = row["start"] + np.arange(row["n"])
            columns = [number, *(np.frombuffer(row[name], np.int64) for name in ("first", "second", "copies"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "first", "second", "copies"])


def _sketch(dimension: int, least: float) -> np.ndarray | None:
    """An orthonormal projection that tells most vectors apart which are no link; None where a
    whole product costs little more."""
    most = math.ceil(dimension * (1 - least) / 0.14)
    if most > 0.6 * dimension:
        return None
    return np.linalg.qr(np.random.default_rng(11).standard_normal((dimension, max(1, most))))[0]


class _Pack:
    """A pack as a task compares it: unit vectors in single precision, and where its cells begin.

    ``left`` of one pack times ``right`` of another is the cosine, or minus half the squared
    distance of the projections, which is no less than the cosine minus one.
    """

    def __init__(self, start: int, cells: bytes, copies: bytes, data: bytes, kind: str, centroids: np.ndarray, sketch: np.ndarray | None, links: dict[int, np.ndarray]):
        self.start = start
        cell, self.copies = np.frombuffer(cells, np.int32), np.frombuffer(copies, np.int64)
        self.vectors = np.frombuffer(data, kind).reshape(len(cell), -1)
        length = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors, dtype=np.float64))
        unit = self.vectors / length[:, None]
        self.unit = self.left = self.right = unit.astype(np.float32)
        if sketch is not None:
            short = unit @ sketch
            half, one = -np.einsum("ij,ij->i", short, short)[:, None] / 2, np.ones((len(cell), 1))
            self.left, self.right = np.hstack([short, half, one]).astype(np.float32), np.hstack([short, one, half]).astype(np.float32)
        self.cells, self.cuts = np.unique(cell, return_index=True)
        self.cuts = [*self.cuts.tolist(), len(cell)]
        self.own = np.einsum("ij,ij->i", self.unit, centroids[cell])
        self.links = links.setdefault(start, np.zeros(len(cell), np.int64))

    def exact(self, rows: np.ndarray) -> np.ndarray:
        return unit_rows(self.vectors[rows].astype(np.float64))


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links between rows and columns that join all that these links join."""
    rows, columns = linked.shape
    if np.count_nonzero(linked) <= 4 * (rows + columns):
        return np.nonzero(linked)
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = linked
    while True:
        x, y = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
        if not len(x):
            return left, right
        left = np.r_[left, x, apart[:, y].argmax(axis=0)]
        right = np.r_[right, apart[x].argmax(axis=1), y]
        root = local_roots(rows + columns, left, right + rows)
        apart = linked & (root[:rows, None] != root[None, rows:])


class _Links:
    """The links that a task has found: a count for each vector, and edges that join what they join."""

    def __init__(self, least: float, centroids: np.ndarray, sketched: bool):
        self.least, self.centroids = least, centroids
        self.slack = _slack(centroids.shape[1])
        self.maybe = (least - 1 if sketched else least) - 2 * self.slack
        self.reach = math.sqrt(max(0.0, 2 - 2 * least))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def compare(self, a: _Pack, b: _Pack) -> None:
        """All pairs of a vector of ``a`` and one of ``b`` that may be linked.

        For x in cell A and y in cell B, (x - y)(A - B) is no more than the longest chord of a
        link times the distance of the centroids; x(A - B) and y(B - A) add up to it.
        """
        toward_b, toward_a = self.centroids[b.cells] @ a.unit.T, self.centroids[a.cells] @ b.unit.T
        for i, cell in enumerate(a.cells):
            of_a = slice(a.cuts[i], a.cuts[i + 1])
            for j in range(i if a is b else 0, len(b.cells)):
                of_b = slice(b.cuts[j], b.cuts[j + 1])
                if cell == b.cells[j]:
                    self._all(a, np.arange(of_a.start, of_a.stop), a.left[of_a], b, np.arange(of_b.start, of_b.stop), b.right[of_b], within=a is b)
                    continue
                most = self.reach * float(np.linalg.norm(self.centroids[cell] - self.centroids[b.cells[j]])) + 4 * self.slack
                from_a, from_b = a.own[of_a] - toward_b[j, of_a], b.own[of_b] - toward_a[i, of_b]
                x, y = np.flatnonzero(from_a <= most - from_b.min()), np.flatnonzero(from_b <= most - from_a.min())
                if not (len(x) and len(y)):
                    continue
                x, y = x[np.argsort(from_a[x])], y[np.argsort(from_b[y])]
                from_a, from_b = from_a[x], from_b[y]
                x, y = x + of_a.start, y + of_b.start
                left, right = a.left[x], b.right[y]
                step = min(TILE_ROWS, max(64, -(-len(x) // 8)))
                for k in range(0, len(x), step):
                    near = int(np.searchsorted(from_b, most - from_a[k], "right"))
                    if not near:
                        break
                    self._all(a, x[k : k + step], left[k : k + step], b, y[:near], right[:near])

    def _all(self, a: _Pack, xs: np.ndarray, left: np.ndarray, b: _Pack, ys: np.ndarray, right: np.ndarray, within: bool = False) -> None:
        """``within``: a cell of a pack with itself, each pair once."""
        for i in range(0, len(xs), TILE_ROWS):
            x = xs[i : i + TILE_ROWS]
            for j in range(0, len(ys), TILE_COLUMNS):
                y = ys[j : j + TILE_COLUMNS]
                if within and y[-1] <= x[0]:
                    continue
                product = left[i : i + TILE_ROWS] @ right[j : j + TILE_COLUMNS].T
                if product.max() >= self.maybe:
                    maybe = product >= self.maybe
                    self._link(a, x, b, y, maybe & (x[:, None] < y[None, :]) if within else maybe)

    def _link(self, a: _Pack, x: np.ndarray, b: _Pack, y: np.ndarray, linked: np.ndarray) -> None:
        """Of the pairs that may be linked, those that are in double precision."""
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(rows):
            return
        x, y, linked = x[rows], y[columns], linked[np.ix_(rows, columns)]
        left, right = a.exact(x), b.exact(y)
        if np.count_nonzero(linked) * 16 <= linked.size:
            i, j = np.nonzero(linked)
            linked[i, j] = np.einsum("ij,ij->i", left[i], right[j]) >= self.least
        else:
            linked &= left @ right.T >= self.least
        a.links[x] += linked @ b.copies[y]
        b.links[y] += a.copies[x] @ linked
        i, j = _spanning(linked)
        if len(i):
            self.edges.append((a.start + x[i], b.start + y[j]))
            self.held += len(i)
            if self.held > MOST_EDGES:
                self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """Each number that has a link, and the lowest that the links found so far join to it."""
        nodes, ends = np.unique(np.concatenate([np.concatenate(ends) for ends in zip(*self.edges)]), return_inverse=True)
        half = len(ends) // 2
        to = nodes[local_roots(len(nodes), ends[:half], ends[half:])]
        self.edges, self.held = [(nodes, to)], 0
        return nodes, to


def _compared(centroids: np.ndarray, sketch: np.ndarray | None, kind: str, least: float):
    """What pairs of packs link: each vector's number, the copies it links with, and one star edge."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Links(least, centroids, sketch is not None)
        counts: dict[int, np.ndarray] = {}
        opened: OrderedDict[int, _Pack] = OrderedDict()

        def pack(batch: pa.RecordBatch, i: int, side: str) -> _Pack:
            start = batch.column(f"{side}_start")[i].as_py()
            if start not in opened:
                blobs = [batch.column(f"{side}_{name}")[i].as_py() for name in ("cells", "copies", "data")]
                opened[start] = _Pack(start, *blobs, kind, centroids, sketch, counts)
            opened.move_to_end(start)
            if len(opened) > OPEN_PACKS:
                opened.popitem(last=False)
            return opened[start]

        for batch in batches:
            for i in range(batch.num_rows):
                found.compare(pack(batch, i, "a"), pack(batch, i, "b"))
            del batch  # or the next one is read beside it
        opened.clear()
        if found.edges:
            nodes, to = found.fold()
            links = np.concatenate([counts[start][counts[start] > 0] for start in sorted(counts)])
            table = pa.Table.from_arrays([pa.array(nodes), pa.array(links), pa.array(to)], ["id", "links", "to"])
            yield from table.to_batches(max_chunksize=1 << 16)
        give_back_memory()

    return compare


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.95,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    dimension: int | None = None,
    fit_rows: int = FIT_ROWS,
    most_cells: int = MOST_CELLS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Two rows are linked if their cosine, in double precision, is ``least`` or more; n_links
    counts the other rows linked directly, component_id is the smallest id reachable over
    links (the row's own included), kept is vec_id = component_id.

    Equal vectors are folded to one class with a count. Centroids are fitted by spherical
    k-means on ``fit_rows`` classes chosen by hash; half the square root of the number of
    classes is the number of cells, ``most_cells`` at most. Every class goes to its nearest cell,
    and cells into packs of ``block`` classes or fewer; a larger cell is dealt by hash. Each pair
    of packs is compared by one task. Of two cells it multiplies the vectors that are near
    enough to the plane between the centroids: those whose places on the line that joins the
    centroids are no farther apart than the longest chord of a link. So no link is lost, whatever
    the centroids. A task returns a count and one star edge for each vector with a link, never its pairs.

    Vectors are shuffled once, to their packs, and written once, as 4 bytes a component if they
    come as FLOAT and as 8 otherwise. Rows meet their class by a hash of 128 bits.

    Vectors of different lengths are spaces of their own, searched one after the other
    (``dimension``: this one only). Vectors that are null, zero, or with null, NaN or infinite
    components link with nothing: n_links 0, component_id their own id. Repeated rows are
    rows of their own and link. A null id gets null component_id and kept unless its
    component has an id that is not null. An empty table gives an empty result.
    """
    rows = pick(vectors, vec_id=id_column, v=vector_column)
    kind = rows.schema["v"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = rows.withColumn("v", F.col("v").cast("array<float>" if single else "array<double>"))
    usable = F.coalesce(_valid(dimension), F.lit(False))
    # how many distinct vectors of each length: an estimate, as it only decides on the number of cells and packs
    lengths = rows.where(usable).groupBy(F.size("v").alias("d")).agg(F.approx_count_distinct(_key(0)).alias("many")).orderBy("d").collect()
    own = F.col("vec_id").cast("long").alias("component_id")
    unlinked = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), own)
    found = unlinked(rows.where(~usable))
    if lengths:
        parts = [_linked(rows.where(usable & (F.size("v") == r["d"])), r["d"], max(1, r["many"]), "f4" if single else "f8", least, fit_rows, most_cells, block) for r in lengths]
        keyed = rows.where(usable).select("vec_id", _key(0).alias("first"), _key(1).alias("second"))
        named = staged(keyed.join(reduce(DataFrame.unionByName, parts), ["first", "second"], "left").select("vec_id", "n_links", "length", "root"), "named")
        linked = named.where("root IS NOT NULL")
        lowest = linked.groupBy("length", "root").agg(F.min("vec_id").cast("long").alias("component_id"))
        found = found.unionByName(unlinked(named.where("root IS NULL")))
        found = found.unionByName(linked.join(lowest, ["length", "root"]).select("vec_id", "n_links", "component_id"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(rows: DataFrame, dimension: int, many: int, kind: str, least: float, fit_rows: int, most_cells: int, block: int) -> DataFrame:
    """``first, second, n_links, length, root``: classes of vectors of one length that link or repeat."""
    keyed = rows.select(_key(0).alias("first"), _key(1).alias("second"), "v")
    share = (2 * fit_rows + 1000) / many
    low = keyed.where(F.col("first") < int((share - 0.5) * 2**64)) if share < 1 else keyed
    chosen = low.groupBy("first").agg(F.first("v").alias("v")).orderBy("first").limit(fit_rows).select("v").collect()
    sample = unit_rows(np.array([r["v"] for r in chosen], np.float64))
    centroids = spherical_kmeans(sample, min(most_cells, max(1, math.ceil(math.sqrt(many) / 2))))
    most = min(block, max(1, PACK_BYTES // (int(kind[1]) * dimension)), max(SMALL_BLOCK, -(-many // PACKS)))
    base, parts, n_packs = _plan(np.bincount((sample @ centroids.T).argmax(axis=1), minlength=len(centroids)) * many / len(sample), most)
    dealt = keyed.mapInArrow(_dealt(centroids, base, parts), "pack int, cell int, first long, second long, copies long, data binary")
    packs = staged(dealt.repartition(n_packs, "pack").groupBy("pack").applyInArrow(_packed(most), _PACK), "packs")
    found = staged(_pack_pairs(packs).mapInArrow(_compared(centroids.astype(np.float32), _sketch(dimension, least), kind, least), "id long, links long, to long"), "found")
    direct = found.groupBy("id").agg(F.sum("links").alias("links"))
    rooted = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "id")
    classes = packs.drop("cells", "data").mapInArrow(_classes, "id long, first long, second long, copies long")
    told = classes.join(direct.join(rooted, "id"), "id", "left").where("links IS NOT NULL OR copies > 1")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return told.select("first", "second", n_links.alias("n_links"), F.lit(dimension).alias("length"), F.coalesce("root", "id").alias("root"))


def _plan(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each cell its first pack and over how many packs it is dealt; the number of packs."""
    parts = np.maximum(1, np.ceil(sizes / most)).astype(np.int64)
    base, at, held = np.zeros(len(sizes), np.int64), -1, float("inf")
    for cell, size in enumerate(sizes.tolist()):
        if parts[cell] > 1 or held + size > most:
            at, held = at + 1, 0.0
        base[cell] = at
        held += size
        at += int(parts[cell]) - 1
    return base, parts, at + 1


def _pack_pairs(packs: DataFrame) -> DataFrame:
    """Each pair of packs, and each pack with itself, once. No pack is shuffled for it."""
    side = lambda name: packs.select(*(F.col(c).alias(f"{name}_{c}") for c in ("start", "cells", "copies", "data")))
    return side("a").join(side("b"), F.col("a_start") <= F.col("b_start"))
