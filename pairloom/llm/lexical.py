"""Ranked lexical search over an index whose documents are grouped by equal length normaliser.

Within a stratum of documents of one normaliser m, what an occurrence count tf is worth depends
on tf alone. So postings lie by term and falling tf, a term's worth is computed once for each
tf, and the largest tf of each term bounds what a stratum can give an item. Strata are visited
by falling bound until none can reach the item's list any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import pick, staged

#: Bytes of item texts that are searched together (a longer item is searched by itself), documents
#: in a block of a stratum, and postings that a task looks at together.
ITEM_BYTES, BLOCK, POSTINGS_AT_ONCE = 4 << 20, 4096, 4_000_000
#: What stands between terms becomes a space, A-Z become small; bytes of other characters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_INDEX = "m long, ids binary, known binary, terms binary, starts binary, docs binary, tfs binary"
_HIT = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z."""
    return text.translate(_PLAIN).split() if text else []


def worth(tf: np.ndarray, m: int) -> np.ndarray:
    """What ``tf`` occurrences count in a document of normaliser ``m``, before the term's weight."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _counted(vocabulary: dict[bytes, int]):
    """Documents as ``id, n, terms, tfs``: all their terms counted, those of the vocabulary listed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()):
                words = terms_of(text.as_py())
                n.append(len(words))
                own, many = np.unique(np.array([vocabulary[w] for w in words if w in vocabulary], np.int32), return_counts=True)
                terms.append(own)
                tfs.append(many)
                ends.append(ends[-1] + len(own))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x or [np.empty(0)]).astype(np.int32))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return count


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that come by normaliser into blocks of one normaliser each, postings by term and
    falling tf."""
    for batch in batches:
        if not batch.num_rows:
            continue
        m = np.asarray(batch.column("m"))
        ids = batch.column("id")
        known = np.asarray(ids.is_valid())
        ids = np.asarray(ids.fill_null(0))
        lists = batch.column("terms")
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        term, tf = np.asarray(lists.flatten()), np.asarray(batch.column("tfs").flatten())
        new = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]).tolist()
        rows = []
        for start, stop in zip(new, [*new[1:], len(m)]):
            for x in range(start, stop, BLOCK):
                y = min(x + BLOCK, stop)
                own, count = term[ends[x] : ends[y]], tf[ends[x] : ends[y]]
                doc = np.repeat(np.arange(y - x, dtype=np.int32), np.diff(ends[x : y + 1]))
                order = np.lexsort((doc, -count, own))
                first = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
                arrays = [ids[x:y], np.packbits(known[x:y]), own[order][first], first, doc[order], count[order]]
                kinds = [np.int64, np.uint8, np.int32, np.int32, np.int32, np.int32]
                rows.append((int(m[x]), *(a.astype(k).tobytes() for a, k in zip(arrays, kinds))))
        kinds = [pa.int64(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["m", "ids", "known", "terms", "starts", "docs", "tfs"])


class _Block:
    """One block of a stratum: bounds for all items, scores of its documents for one."""

    def __init__(self, row: dict, weights: np.ndarray):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.m, self.ids = row["m"], read("ids", np.int64)
        self.known = np.unpackbits(read("known", np.uint8), count=len(self.ids)).astype(bool)
        self.terms, starts = read("terms", np.int32), read("starts", np.int32).astype(np.int64)
        self.docs, self.tfs = read("docs", np.int32), read("tfs", np.int32)
        self.span = dict(zip(self.terms.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(self.docs)])))
        # postings begin with the largest tf
        self.most = weights[self.terms] * worth(self.tfs[starts], self.m)
        self.weights = weights
        self.given: dict[int, np.ndarray] = {}

    def _gives(self, term: int, x: int, y: int) -> np.ndarray:
        """What each posting of the term adds to a score, computed once for each tf."""
        if term not in self.given:
            tf = self.tfs[x:y]
            first = np.flatnonzero(np.r_[True, tf[1:] != tf[:-1]])
            self.given[term] = np.repeat(self.weights[term] * worth(tf[first], self.m), np.diff(np.r_[first, len(tf)]))
        return self.given[term]

    def scores(self, terms: list[int], times: list[int]) -> np.ndarray:
        total = np.zeros(len(self.ids), np.int64)
        for term, often in zip(terms, times):
            if term in self.span:
                x, y = self.span[term]
                total[self.docs[x:y]] += often * self._gives(term, x, y)
        return total


class _Best:
    """The best documents of an item so far: score, whether the id is null, and the id."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor = top, floor
        self.score, self.known, self.id = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def least(self) -> int:
        """A score below this one has no place in the list."""
        return max(1, self.floor, int(self.score[-1]) if len(self.score) == self.top else 0)

    def add(self, block: _Block, scores: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least())
        if len(at):
            score, known, id = np.r_[self.score, scores[at]], np.r_[self.known, block.known[at]], np.r_[self.id, block.ids[at]]
            order = np.lexsort((id, ~known, -score))[: self.top]
            self.score, self.known, self.id = score[order], known[order], id[order]


def _visits(items: list[tuple[list[int], list[int]]], weights: np.ndarray, top: int, floors: list[int], only_first: bool):
    """The best ``top`` documents of a task's blocks for each item. ``floors`` are scores that
    ``top`` documents are known to reach. With ``only_first`` each item visits the block of its
    highest bound alone, in each lot of blocks."""
    flat = np.concatenate([np.array(t, np.int64) for t, _ in items])
    often = np.concatenate([np.array(c, np.int64) for _, c in items])
    starts = np.cumsum([0, *(len(t) for t, _ in items)])[:-1]

    def bounds(block: _Block) -> np.ndarray:
        most = np.zeros(len(weights), np.int64)
        most[block.terms] = block.most
        return np.add.reduceat(most[flat] * often, starts)

    def visit(lot: list[_Block], best: list[_Best]) -> None:
        bound = np.stack([bounds(b) for b in lot])
        order = np.argsort(-bound, axis=0, kind="stable")
        for i, own in enumerate(best):
            for b in order[: 1 if only_first else None, i].tolist():
                if bound[b, i] < own.least():
                    break
                own.add(lot[b], lot[b].scores(*items[i]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top, floor) for floor in floors]
        lot: list[_Block] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                lot.append(_Block(batch.slice(i, 1).to_pylist()[0], weights))
                size += len(lot[-1].docs)
                if size >= POSTINGS_AT_ONCE:
                    visit(lot, best)
                    lot, size = [], 0
        if lot:
            visit(lot, best)
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        ids = pa.array(np.concatenate([b.id for b in best]), pa.int64(), mask=~np.concatenate([b.known for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(np.concatenate([b.score for b in best]), pa.int64())], ["item", "doc_id", "score"])

    return search


def _searched(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame | None:
    """``key, doc_id, score`` of the best documents for a bounded list of (key, terms)."""
    vocabulary: dict[bytes, int] = {}
    asked = []
    for key, terms in items:
        numbers, times = np.unique([vocabulary.setdefault(w, len(vocabulary)) for w in terms], return_counts=True)
        asked.append((numbers.tolist(), times.tolist()))
    listed = staged(docs.mapInArrow(_counted(vocabulary), "id long, n long, terms array<int>, tfs array<int>"), "terms")
    total = listed.where("n > 0").agg(F.count("*").alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms")).alias("postings")).first()
    if not total["N"]:
        return None
    many, length = total["N"], total["L"]
    held = listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * many + 2) / (2.0 * F.col("df") + 1)))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in held.select("term", weight.alias("w")).collect():  # terms of the items alone
        weights[row["term"]] = row["w"]
    m = F.expr(f"25 + (cast({75 * many} as decimal(24, 0)) * cast(n as decimal(13, 0))) div cast({length} as decimal(24, 0))")
    parts = max(1, ceil(total["postings"] / POSTINGS_AT_ONCE * 4))
    ordered = listed.where("size(terms) > 0").select(m.alias("m"), "id", "terms", "tfs").repartitionByRange(parts, "m", "id").sortWithinPartitions("m", "id")
    index = staged(ordered.mapInArrow(_blocks, _INDEX), "strata")
    # scores that each item's list reaches from the most promising blocks alone
    probed = index.mapInArrow(_visits(asked, weights, top, [0] * len(asked), True), _HIT)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    floors = [0] * len(asked)
    for row in probed.withColumn("place", place).where(F.col("place") == top).collect():  # one row an item
        floors[row["item"]] = row["score"]
    hits = index.mapInArrow(_visits(asked, weights, top, floors, False), _HIT)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = hits.withColumn("rank", place).where(F.col("rank") <= top)
    keys = docs.sparkSession.createDataFrame([(n, key) for n, (key, _) in enumerate(items)], "item int, key long")
    return staged(best.join(F.broadcast(keys), "item").select("key", "rank", "doc_id", "score"), "hits")


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of highest score for each row of
    ``items``, by falling score, equal scores by ascending id; those without a common term have
    score 0 and no row.

    N documents have a term, L is the number of all their terms, n that of one document's, df the
    number of documents that hold a term, tf how often one does. A term weighs
    w = floor(1000 ln((2N + 2) / (2 df + 1))); a document's normaliser is m = 25 + 75 n N div L; its
    score sums w ((10**9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included.

    The index holds every document, with the postings of the items' terms. Items are searched in
    lots of ``ITEM_BYTES`` of text, equal texts once. Null and empty texts have no terms: such a document is
    not counted, such an item has no rows. Repeated rows of ``docs`` rank one by one; each of
    repeated rows of ``items`` has its rows. Null ids of documents come last among equal scores.
    Empty tables give an empty result. Further columns are ignored.
    """
    own = pick(docs, id=id_column, text=text_column).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    asked = pick(items, item_id=item_id, text=item_text).select("item_id", F.col("text").cast("string").alias("text"))
    asked = staged(asked.withColumn("digest", F.sha2("text", 256)), "items")
    texts = asked.where("text is not null").groupBy("digest").agg(F.first("text").alias("text"))
    texts = staged(texts.withColumn("key", F.monotonically_increasing_id()), "texts")
    lots = ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES)
    found: list[DataFrame] = []
    for lot in range(lots):
        rows = texts.where(F.pmod(F.xxhash64("digest"), F.lit(lots)) == lot).select("key", "text").collect()
        with_terms = [(r["key"], terms) for r in rows if (terms := terms_of(r["text"].encode("utf-8", "surrogatepass")))]
        hits = _searched(own, with_terms, top) if with_terms else None
        if hits is not None:
            found.append(hits)
    if not found:
        none = {"rank": "int", "doc_id": "long", "score": "long"}
        return asked.limit(0).select("item_id", *(F.lit(None).cast(kind).alias(name) for name, kind in none.items()))
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    return asked.join(texts.select("digest", "key"), "digest").join(hits, "key").select("item_id", "rank", "doc_id", "score")
