"""Near duplicates by SimHash, searched with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import pick, renamed_back, staged, text_or_empty, with_columns_of
from pairloom.llm.components import components, local_roots

BITS = 64
#: Shingles whose hashes are unpacked to bits at a time.
SHINGLES_AT_ONCE = 1 << 15
#: Fingerprints in a leaf of the index, and most of them that one node holds.
LEAF, NODE = 32, 1024


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit number."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(words, len(parts))
    begin, end = starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begin), SHINGLES_AT_ONCE):
        hashes = np.array(
            [digest(joined[s:e], seed) for s, e in zip(begin[at : at + SHINGLES_AT_ONCE], end[at : at + SHINGLES_AT_ONCE])],
            dtype="<u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(begin)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(text_column: str, words: int = 4, seed: int = 42):
    """Column of fingerprints (long); a text without words has fingerprint 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return of(text_or_empty(text_column))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each unsigned value in the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def shared_pattern(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``values`` from a start: the mask of bits all agree in, and those bits."""
    ones, some = np.bitwise_and.reduceat(values, starts), np.bitwise_or.reduceat(values, starts)
    return ~(ones ^ some), ones


def search_within(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in Gray-ordered ``values`` that differ in ``most`` bits at most."""
    return search_between(values, values, most, same=True)


def _checked(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs ``(i, j)``, those whose second fingerprints differ in ``most`` bits at most."""
    near = np.bitwise_count(left[i] ^ right[j]) <= most
    return i[near], j[near]


def search_between(left: np.ndarray, right: np.ndarray, most: int, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``left``, place in ``right``) that differ in ``most`` bits at most.

    Both are in Gray order and cut into levels of nodes, ``LEAF`` children each. A node keeps
    the bits that all below it share. From the top, two nodes whose shared bits alone differ
    in more than ``most`` places are dropped with all below them.
    """
    levels = []
    for values in (left, right):
        own, size = [], LEAF
        while True:
            starts = np.arange(0, len(values), size)
            own.append((size, *shared_pattern(values, starts)))
            if len(starts) <= LEAF:
                break
            size *= LEAF
        levels.append(own)
    depth = max(map(len, levels))
    for own in levels:
        while len(own) < depth:
            own.append(own[-1])
    a, b = (x.ravel() for x in np.meshgrid(*(np.arange(len(own[-1][1])) for own in levels), indexing="ij"))
    for level in range(depth - 1, -1, -1):
        (size_a, mask_a, bits_a), (size_b, mask_b, bits_b) = levels[0][level], levels[1][level]
        if same:
            a, b = a[a <= b], b[a <= b]
        near = np.bitwise_count((bits_a[a] ^ bits_b[b]) & mask_a[a] & mask_b[b]) <= most
        a, b = a[near], b[near]
        below = [own[level - 1][0] if level else 1 for own in levels]
        grown = [size_a // below[0], size_b // below[1]]
        count = [len(own[level - 1][1]) if level else len(v) for own, v in zip(levels, (left, right))]
        a = (a[:, None] * grown[0] + np.arange(grown[0])).repeat(grown[1], axis=1).ravel()
        b = np.tile(b[:, None] * grown[1] + np.arange(grown[1]), (1, grown[0])).ravel()
        inside = (a < count[0]) & (b < count[1])
        a, b = a[inside], b[inside]
    near = np.bitwise_count(left[a] ^ right[b]) <= most
    if same:
        near &= a < b
    return a[near], b[near]


def _key_masks(most: int, blocks: int) -> list[int]:
    """Masks of the ``blocks - most`` blocks that two near fingerprints agree in, all choices."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(block, blocks - most)]


def _stars(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link per node that keeps what ``left - right`` connect connected."""
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = local_roots(len(used), place[: len(left)], place[len(left) :])
    moved = root != np.arange(len(used))
    return ids[used[moved]], ids[used[root[moved]]]


def _pairs_in_short_runs(fps: np.ndarray, size: np.ndarray, most: int) -> tuple[list, list]:
    """Near pairs in runs of ``LEAF`` rows at most, all runs at once: each row with the row
    1, 2, ... places on, while that is in its run."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends = np.cumsum(size)
    short = np.repeat(np.where(size <= LEAF, ends, 0), size)
    rows = np.arange(len(fps))
    for lag in range(1, LEAF):
        rows = rows[rows + lag < short[rows]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fps[rows] ^ fps[rows + lag]) <= most]
        left.append(near)
        right.append(near + lag)
    return left, right


def _nodes(most: int, most_second: int):
    """Cut Gray-ordered runs of each bucket into nodes and search inside each node."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        number = 0

        def out(kind, choice, bucket, node, a, b, fp=0, second=0):
            size = len(a)
            full = lambda x, dtype: np.broadcast_to(np.asarray(x, dtype), size)
            return pd.DataFrame({"kind": full(kind, "int32"), "choice": full(choice, "int32"), "bucket": full(bucket, "int64"), "node": full(node, "int64"), "a": a, "b": b, "fp": full(fp, "int64"), "second": full(second, "int64")})

        def solve(frame: pd.DataFrame, edge: bool) -> Iterator[pd.DataFrame]:
            """edge: the run may go on in a neighbouring part, so its node takes part in phase two."""
            nonlocal number
            choice, bucket = frame["choice"].to_numpy(), frame["bucket"].to_numpy()
            fps, second, ids = frame["fp"].to_numpy().view(np.uint64), frame["second"].to_numpy().view(np.uint64), frame["id"].to_numpy()
            new = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (bucket[1:] != bucket[:-1])])
            stop = np.r_[new[1:], len(frame)]
            last = len(new) - 1
            size = stop - new
            left, right = _pairs_in_short_runs(fps, size, most)
            for i in np.flatnonzero(size > LEAF):
                for at in range(new[i], stop[i], NODE):
                    x, y = search_within(fps[at : min(at + NODE, stop[i])], most)
                    left.append(x + at)
                    right.append(y + at)
            pairs = _checked(second, second, np.concatenate(left), np.concatenate(right), most_second)
            yield out(0, 0, 0, 0, *_stars(ids, *pairs))
            for i in range(len(new)):
                if stop[i] - new[i] > NODE or edge and i in (0, last):
                    for at in range(new[i], stop[i], NODE):
                        own = slice(at, min(at + NODE, stop[i]))
                        yield out(1, choice[new[i]], bucket[new[i]], number, ids[own], ids[own], fps[own].view(np.int64), second[own].view(np.int64))
                        number += 1

        # whole buckets are solved together; the last bucket of a batch waits for the next batch
        first = True
        for frame in batches:
            if frame.empty:
                continue
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            c, k = held["choice"].to_numpy(), held["bucket"].to_numpy()
            start = int(np.flatnonzero((c != c[-1]) | (k != k[-1]))[-1]) + 1 if ((c != c[-1]) | (k != k[-1])).any() else 0
            if start == 0 and len(held) < 8 * NODE:
                continue
            upto = start or len(held)
            yield from solve(held.iloc[:upto].reset_index(drop=True), first or start == 0)
            first = start == 0
            held = held.iloc[upto:].reset_index(drop=True) if upto < len(held) else None
        if held is not None:
            yield from solve(held, True)

    return cut


def fingerprint_components(fps: DataFrame, most: int = 4, blocks: int = 6, most_second: int = BITS) -> DataFrame:
    """``(id, fp, second)`` to ``(node, root)``: which ids are linked, over any number of steps, by
    pairs whose ``fp`` differ in ``most`` bits and ``second`` in ``most_second`` bits at most.
    Ids without a link have no row.

    Two such fingerprints agree in ``blocks - most`` of the ``blocks`` bit blocks. Each
    fingerprint is listed once for each choice of that many blocks; the list is sorted by
    (choice, agreed bits, Gray rank) over all tasks and cut into nodes of ``NODE`` rows. Pairs
    inside a node are found in the task that sorted it. A bucket that spans nodes, however
    large, has its nodes compared pairwise by their shared bits, and only pairs of nodes that
    may hold a link are opened, each in a group of two nodes. No bucket is ever held whole,
    and links leave a task as stars: one per fingerprint at most, whatever the pairs.
    """
    masks = _key_masks(most, blocks)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]

    choices = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(signed)))).alias("c")
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    # an unsigned order is a signed one with the top bit turned
    order = rank.bitwiseXOR(F.lit(-(1 << (BITS - 1)))).alias("gray")
    listed = fps.select("id", "fp", "second", order).select("id", "fp", "second", "gray", choices).select("c.choice", "c.bucket", "gray", "fp", "second", "id")
    parts = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = listed.repartitionByRange(int(parts), "choice", "bucket", "gray").sortWithinPartitions("choice", "bucket", "gray")
    found = staged(
        dealt.drop("gray")
        .mapInPandas(_nodes(most, most_second), "kind int, choice int, bucket long, node long, a long, b long, fp long, second long")
        .withColumn("part", F.spark_partition_id()),
        "nodes",
    )
    links = found.where("kind = 0").select("a", "b")
    across = found.where("kind = 1").select("choice", "bucket", "part", "node", F.col("a").alias("of"), "fp", "second")
    return components(links.union(_links_across(across, most, most_second)))


def _links_across(rows: DataFrame, most: int, most_second: int) -> DataFrame:
    """Links between different nodes of one bucket. rows: choice, bucket, part, node, of, fp, second."""
    keys = ["choice", "bucket", "part", "node"]
    nodes = rows.groupBy(*keys).agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some"))
    nodes = nodes.select("choice", "bucket", F.struct("part", "node").alias("id"), "ones", F.bitwise_not(F.col("ones").bitwiseXOR(F.col("some"))).alias("mask"))
    nodes = staged(nodes, "upper")
    x, y = nodes.alias("x"), nodes.alias("y")
    differ = F.bit_count(F.col("x.ones").bitwiseXOR(F.col("y.ones")).bitwiseAND(F.col("x.mask")).bitwiseAND(F.col("y.mask")))
    pairs = x.join(y, (F.col("x.choice") == F.col("y.choice")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (differ <= most))
    pairs = pairs.select(F.col("x.id").alias("left"), F.col("y.id").alias("right"))
    sides = pairs.select(F.posexplode(F.array("left", "right")).alias("side", "id"), "left", "right")
    opened = sides.join(rows.select(F.struct("part", "node").alias("id"), "of", "fp", "second"), "id").select("left", "right", "side", "of", "fp", "second")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        each = []
        for side in (0, 1):
            own = frame[frame["side"] == side]
            fp = own["fp"].to_numpy().view(np.uint64)
            order = np.argsort(gray_rank(fp))
            each.append((fp[order], own["second"].to_numpy().view(np.uint64)[order], own["of"].to_numpy()[order]))
        (x, x_second, x_of), (y, y_second, y_of) = each
        if not len(x) or not len(y):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        i, j = _checked(x_second, y_second, *search_between(x, y, most), most_second)
        a, b = _stars(np.concatenate([x_of, y_of]), i, j + len(x))
        return pd.DataFrame({"a": a, "b": b})

    return opened.groupBy("left", "right").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint_bits`` (long) and ``component_id``.

    The fingerprint has a bit where over half the XXH64 hashes of the ``words``-word shingles
    have it. Rows whose fingerprints differ in ``most`` bits at most are linked; component_id
    is the smallest id that can be reached over links, the row's own included.

    Null, empty and white-space texts have no words: fingerprint 0, linked like any other.
    Texts with fewer words than a shingle hash whole. Repeated rows each get a row. A null id
    keeps its row and never counts as smallest; a component of null ids has a null
    component_id. An empty table gives an empty result. Further columns are ignored.
    """
    own = pick(docs, doc_id=id_column, text=text_column)
    marked = staged(own.select("doc_id", fingerprints("text", words).alias("fp"), F.lit(0).cast("long").alias("second")), "fingerprints")
    return with_components(marked, most).select("doc_id", F.col("fp").alias("fingerprint_bits"), "component_id")


def with_components(marked: DataFrame, most: int, blocks: int = 6, most_second: int = BITS) -> DataFrame:
    """Rows with ``doc_id``, ``fp`` and ``second``: adds ``root`` (of the component) and ``component_id``."""
    known = marked.groupBy("fp", "second").agg(F.min("doc_id").alias("low"))
    known = staged(known.withColumn("id", F.monotonically_increasing_id()), "known")
    found = fingerprint_components(known, most, blocks, most_second)
    rooted = known.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = staged(rooted.select("fp", "second", "root").join(lowest, "root"), "named")
    return marked.join(named, ["fp", "second"])


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`: the one with the
    smallest id (null ids last, and any one of rows that repeat an id). Columns and their order stay.

    Null and empty texts have equal fingerprints, so one of them stays. No rows: no rows.
    """
    all_rows, own = with_columns_of(docs, doc_id=id_column, text=text_column)
    numbered = all_rows.select(*own, "doc_id", fingerprints("text", words).alias("fp"), F.lit(0).cast("long").alias("second"))
    marked = staged(numbered.withColumn("row", F.monotonically_increasing_id()), "marked")
    rooted = with_components(marked.select("doc_id", "row", "fp", "second"), most)
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("first"))
    return renamed_back(marked.join(kept.select("first.row"), "row", "left_semi"), own, docs.columns)
