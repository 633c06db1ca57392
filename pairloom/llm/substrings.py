"""Passages that repeat anywhere in a corpus, by level-wise doubling of word windows.

Texts are packed once into blobs of a few megabytes, written as a table bucketed by pack, and
never shuffled. A level looks at windows of one length. Each pack sends the sorted distinct
hashes of its candidate windows to groups by hash range and gets one bit back for each. Only
windows that repeat stay candidates; a window of the next length is a candidate if the two
that it is made of are. What travels is a few bytes for each candidate of a pack, however
often it repeats there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import shared_folder, staged

#: Bytes of text in a pack (one longer text is a pack by itself), packs in a bucket, and
#: hashes in a group of a level, all on average.
PACK_BYTES, PACKS_IN_BUCKET, HASHES_IN_GROUP = 8 << 20, 4, 2_000_000
#: The shortest windows have this many words or fewer.
SHORTEST = 5
#: Bits of a level's hashes beyond the logarithm of their number: one in 2**SPARE stays a
#: candidate wrongly, which costs work at the next level only. The last level's hashes have twice
#: the logarithm and SURE bits: no two of all its windows agree wrongly, but for a chance below 2**-SURE.
SPARE, SURE = 8, 32
_ODD_A, _ODD_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MADE = ["+n_words", "+n_removed", "+removed", "+kept_text"]
_GROUP = "level int, bucket int, pack long, n int, bits binary, alive long"


def lengths_of(window: int) -> list[int]:
    """Window lengths of the levels: each is made of two (maybe overlapping) of the one before."""
    if window < 1:
        raise ValueError("a window has at least one word")
    found = [window]
    while found[-1] > SHORTEST:
        found.append(-(-found[-1] // 2))
    return found[::-1]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * _ODD_A + (b ^ (b >> np.uint64(31))) * _ODD_B
    x = (x ^ (x >> np.uint64(29))) * _ODD_B
    return x ^ (x >> np.uint64(32))


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, so that bytes which are mostly zero compress to nothing."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, n).T).view(np.uint64).ravel()


def _ascending(values: np.ndarray) -> bytes:
    return _planes(np.diff(values.view(np.uint64), prepend=np.uint64(0)))


def _from_ascending(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(data, n), dtype=np.uint64)


def _packs(text_at: int, most: int = PACK_BYTES) -> Callable:
    """Rows into packs: ``n_rows`` and ``data``, the rows as an Arrow stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for part in held:
                    stream.write_batch(part)
            rows = sum(part.num_rows for part in held)
            return pa.RecordBatch.from_arrays([pa.array([rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n_rows", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0), np.int64)
            at = 0
            while at < batch.num_rows:
                upto = np.cumsum(sizes[at:])
                many = max(int(np.searchsorted(upto, most - size, "right")), 0 if held else 1)
                if many:
                    held.append(batch.slice(at, many))
                    size += int(upto[many - 1])
                    at += many
                if at < batch.num_rows:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return pack


class _Pack:
    """The words of a pack's texts in document order, and its candidate windows level by level."""

    def __init__(self, data: bytes, id_at: int, text_at: int, lengths: list[int]):
        self.rows = pa.ipc.open_stream(data).read_all().combine_chunks()
        self.lengths, self.window = lengths, lengths[-1]
        texts = pc.fill_null(self.rows.column(text_at), "").combine_chunks()
        split = pc.ascii_split_whitespace(texts)
        parts, cuts = split.flatten(), np.asarray(split.offsets)
        real = np.asarray(pc.binary_length(parts)) > 0  # white space at an end leaves an empty part
        self.words = parts.filter(pa.array(real))
        self.cuts = np.r_[0, np.cumsum(real)][cuts]
        self.counts = np.diff(self.cuts)
        ids = self.rows.column(id_at).cast(pa.int64())
        known = np.asarray(ids.is_valid())
        ids = np.asarray(pc.fill_null(ids, 0), np.int64)
        # a document is an id and a text: rows that repeat both are one; null ids come first
        tie = np.array(list(map(xxhash.xxh64_intdigest, texts.cast(pa.binary()).to_pylist())), np.uint64)
        long = np.flatnonzero(self.counts >= self.window)
        order = long[np.lexsort((tie[long], ids[long], known[long]))]
        same = lambda x: x[order][1:] == x[order][:-1]
        again = np.r_[False, same(tie) & same(ids) & same(known)][: len(order)]
        self.docs, self.of_row = order[~again], np.full(len(texts), -1)
        self.of_row[order] = np.cumsum(~again) - 1
        self.ids = np.where(known, ids, np.iinfo(np.int64).min)[self.docs]
        self.ties = tie[self.docs]
        counts = self.counts[self.docs]
        self.ends = np.cumsum(counts)
        place = np.arange(int(counts.sum()))
        self.room = np.repeat(self.ends, counts) - place
        number = self.words.dictionary_encode()
        of = np.asarray(number.indices)[place + np.repeat(self.cuts[self.docs] - self.ends + counts, counts)]
        digests = b"".join(map(xxhash.xxh3_128_digest, number.dictionary.cast(pa.binary()).to_pylist()))
        first, second = (np.ascontiguousarray(lane)[of] for lane in np.frombuffer(digests, "<u8").reshape(-1, 2).T)
        short = lengths[0]
        a, b = first.copy(), second.copy()
        for lag in range(1, short):
            a[:-lag], b[:-lag] = _mixed(a[:-lag], first[lag:]), _mixed(b[:-lag], second[lag:])
        self.a, self.b = a, b
        self.at = np.flatnonzero(self.room >= short)
        self.level = 0

    def keys(self, bits: int) -> np.ndarray:
        return self.a[self.at] >> np.uint64(64 - bits)

    def extend(self, bits: int, alive: np.ndarray) -> None:
        """Go on to windows of the next length; ``alive`` tells for each distinct key if it repeats."""
        stays = np.zeros(len(self.a), bool)
        keys = self.keys(bits)
        order = np.argsort(keys)
        keys = keys[order]
        stays[self.at[order]] = alive[np.cumsum(np.r_[True, keys[1:] != keys[:-1]][: len(keys)]) - 1]
        now, then = self.lengths[self.level : self.level + 2]
        step = then - now
        at = self.at[stays[self.at] & (self.room[self.at] >= then)]
        at = at[stays[at + step]]
        a, b = _mixed(self.a[at], self.a[at + step]), _mixed(self.b[at], self.b[at + step])
        self.a[at], self.b[at], self.at = a, b, at
        self.level += 1

    def whole(self, low_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of full length by hash: hash, its low part, the place, and where a new hash begins."""
        a, low = self.a[self.at], self.b[self.at] & np.uint64((1 << low_bits) - 1)
        order = np.lexsort((low, a))
        a, low, at = a[order], low[order], self.at[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (low[1:] != low[:-1])][: len(at)]
        return a, low, at, new

    def covered(self, low_bits: int, earlier: np.ndarray) -> np.ndarray:
        """Words in a window that starts earlier too; ``earlier`` tells for each distinct window
        if it does so in a document of another pack."""
        _, _, at, new = self.whole(low_bits)
        begin = at[earlier[np.cumsum(new) - 1] | ~new]
        step = np.zeros(len(self.a) + 1, np.int64)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + self.window, -1)
        return np.cumsum(step)[:-1] > 0


def _edges(groups: int, bits: int) -> np.ndarray:
    return np.array([(k << bits) // groups for k in range(1, groups)], np.uint64)


def _replies(row: dict) -> dict[int, np.ndarray]:
    """Bits by level, in the order of the distinct hashes that a pack sent."""
    found: dict[int, list] = {}
    for level, bucket, n, bits in sorted((r["level"], r["bucket"], r["n"], r["bits"]) for r in row["replies"] or ()):
        found.setdefault(level, []).append(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool))
    return {level: np.concatenate(parts) for level, parts in found.items()}


def _opened(make: Callable[[bytes], _Pack], bits: list[int], level: int) -> Callable:
    """For each pack: its number, the pack with the candidates of ``level``, and all replies."""
    none = np.zeros(0, bool)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Pack, dict]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pack, replies = make(row["data"]), _replies(row)
                for k in range(level):
                    pack.extend(bits[k], replies.get(k, none))
                yield row["pack"], pack, replies

    return each


def _candidates(opened: Callable, bits: int, groups: int) -> Callable:
    """The distinct hashes of each pack's windows by group, and which repeat in the pack itself."""

    def send(batches):
        for number, pack, _ in opened(batches):
            keys, counts = np.unique(pack.keys(bits), return_counts=True)
            cut = [0, *np.searchsorted(keys, _edges(groups, bits)).tolist(), len(keys)]
            rows = [(k, number, y - x, _ascending(keys[x:y]), np.packbits(counts[x:y] > 1).tobytes()) for k, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_arrow("bucket:i pack:l n:i keys:b again:b"))

    return send


def _arrow(fields: str) -> pa.Schema:
    kinds = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(":") for f in fields.split())])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _answers(level: int, table: pa.Table, marks: np.ndarray) -> pa.Table:
    """One row for each pack of a group, with its part of ``marks`` as bits."""
    rows = table.select(["bucket", "pack", "n"]).to_pydict()
    parts = np.split(marks, np.cumsum(rows["n"])[:-1])
    columns = [[level] * len(parts), rows["bucket"], rows["pack"], rows["n"], [np.packbits(p).tobytes() for p in parts], [int(p.sum()) for p in parts]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow("level:i bucket:i pack:l n:i bits:b alive:l"))], schema=_arrow("level:i bucket:i pack:l n:i bits:b alive:l"))


def _repeated(level: int) -> Callable[[pa.Table], pa.Table]:
    """Marks the hashes of a group that more than one pack sent, or that repeat in their pack."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        keys = _joined([_from_ascending(d, n) for d, n in zip(rows["keys"], rows["n"])])
        again = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8), count=n) for d, n in zip(rows["again"], rows["n"])]).astype(bool)
        order = np.argsort(keys, kind="stable")
        equal = keys[order][1:] == keys[order][:-1]
        marks = np.zeros(len(keys), bool)
        marks[1:] = equal
        marks[:-1] |= equal
        again[order] |= marks
        return _answers(level, table, again)

    return answer


def _first_places(opened: Callable, low_bits: int, groups: int) -> Callable:
    """Each pack's distinct windows of full length by group, with the first document of each."""

    def send(batches):
        for number, pack, _ in opened(batches):
            a, low, at, new = pack.whole(low_bits)
            a, low = a[new], low[new]
            doc = np.searchsorted(pack.ends, at[new], "right")
            cut = [0, *np.searchsorted(a, _edges(groups, 64)).tolist(), len(a)]
            rows = []
            for k, (x, y) in enumerate(zip(cut, cut[1:])):
                if y > x:
                    docs, own = np.unique(doc[x:y], return_inverse=True)
                    rows.append((k, number, y - x, _ascending(a[x:y]), _planes(low[x:y]), _planes(own.astype(np.uint64)), len(docs), _ascending(pack.ids[docs]), _planes(pack.ties[docs])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_arrow("bucket:i pack:l n:i keys:b low:b doc:b n_docs:i ids:b ties:b"))

    return send


def _not_first(level: int) -> Callable[[pa.Table], pa.Table]:
    """Marks the windows of a group that an earlier document of another pack has too."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        many = list(zip(rows["n"], rows["n_docs"]))
        own = [_unplanes(d, n).astype(np.int64) for d, (n, _) in zip(rows["doc"], many)]
        keys = _joined([_from_ascending(d, n) for d, (n, _) in zip(rows["keys"], many)])
        low = _joined([_unplanes(d, n) for d, (n, _) in zip(rows["low"], many)])
        ids = _joined([_from_ascending(d, n)[o] for d, o, (_, n) in zip(rows["ids"], own, many)]).view(np.int64)
        ties = _joined([_unplanes(d, n)[o] for d, o, (_, n) in zip(rows["ties"], own, many)])
        order = np.lexsort((ties, ids, low, keys))
        keys, low = keys[order], low[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (low[1:] != low[:-1])][: len(order)]
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        marks = np.zeros(len(order), bool)
        marks[order] = (ids[order] != ids[first]) | (ties[order] != ties[first])
        return _answers(level, table, marks)

    return answer


def _cleaned(opened: Callable, low_bits: int, level: int) -> Callable:
    """The rows of each pack with word count, removed stretches and the words left."""
    none = np.zeros(0, bool)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def clean(batches):
        for _, pack, replies in opened(batches):
            gone = pack.covered(low_bits, replies.get(level, none))
            stays = np.ones(len(pack.words), bool)
            for row in np.flatnonzero(pack.of_row >= 0).tolist():
                end = int(pack.ends[pack.of_row[row]])
                stays[pack.cuts[row] : pack.cuts[row + 1]] = ~gone[end - pack.counts[row] : end]
            before = np.r_[0, np.cumsum(stays)][pack.cuts]
            lost = pack.counts - np.diff(before)
            spans: list[list] = [[] for _ in lost]
            for row in np.flatnonzero(lost).tolist():
                own = ~stays[pack.cuts[row] : pack.cuts[row + 1]]
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                spans[row] = [{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])]
            left = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pack.words.filter(pa.array(stays)))
            more = [pa.array(pack.counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, span), pc.binary_join(left, " ")]
            yield from pa.Table.from_arrays([*pack.rows.columns, *more], [*pack.rows.column_names, *_MADE]).to_batches()

    return clean


def repeated_passages(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text_column: str = "text", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``docs`` and four columns: ``n_words``, ``n_removed``, ``removed`` (stretches of words, from
    ``start`` up to ``end``) and ``kept_text``, the words that are left, joined by one space.

    Words are runs of characters other than ASCII white space. Each word goes that is covered by
    a window of ``window`` words whose word sequence also starts earlier: in a document of
    smaller id, or in the same one at an earlier word. Windows are judged on the texts as they
    come. Longer repeats consist of such windows, so the levels end at this length, or before
    it where no candidate is left.

    Ids are integers. A null id comes before all others. Rows that share an id are ordered by a
    hash of their texts; rows that share id and text are one document and get equal results.
    Null and empty texts have no words; texts shorter than a window lose none. An empty table
    gives an empty result. Further columns stay; a new column whose name is taken is numbered.
    """
    names = docs.columns
    id_at, text_at = names.index(id_column), names.index(text_column)
    flat = docs.toDF(*(f"_{i}" for i in range(len(names))))
    text = flat[f"_{text_at}"].cast("string")
    flat = flat.withColumns({f"_{id_at}": F.col(f"_{id_at}").cast("long"), f"_{text_at}": text})
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kinds = [T.LongType(), T.LongType(), spans, T.StringType()]
    made = T.StructType([*flat.schema.fields, *(T.StructField(n, k) for n, k in zip(_MADE, kinds))])

    packs = _bucketed(flat, text_at, pack_bytes)
    lengths = lengths_of(window)
    make = lambda data: _Pack(data, id_at, text_at, lengths)
    last = len(lengths) - 1
    replies: list[DataFrame] = []
    bits: list[int] = []
    many = int(flat.agg(F.sum(F.octet_length(f"_{text_at}"))).first()[0] or 0) // 2 + 1  # words are no more than this
    for level in range(last + 1):
        groups = ceil(many / HASHES_IN_GROUP)
        if level < last:
            bits.append(min(64, ceil(log2(many + 2)) + SPARE))
            sent = _with_replies(packs, replies).mapInArrow(_candidates(_opened(make, bits, level), bits[level], groups), "bucket int, pack long, n int, keys binary, again binary")
            answered = sent.groupBy("bucket").applyInArrow(_repeated(level), _GROUP)
        else:
            low_bits = min(64, max(0, 2 * ceil(log2(many + 2)) + SURE - 64))
            sent = _with_replies(packs, replies).mapInArrow(_first_places(_opened(make, bits, level), low_bits, groups), "bucket int, pack long, n int, keys binary, low binary, doc binary, n_docs int, ids binary, ties binary")
            answered = sent.groupBy("bucket").applyInArrow(_not_first(level), _GROUP)
        replies.append(staged(answered, f"level-{lengths[level]}"))
        many = max(1, int(replies[-1].agg(F.sum("alive")).first()[0] or 0))
    cleaned = _with_replies(packs, replies).mapInArrow(_cleaned(_opened(make, bits, last), low_bits, last), made)
    taken = {n.lower() for n in names}
    new = []
    for name in _MADE:
        name = name[1:]
        while name.lower() in taken:
            name += "_1"
        new.append(name)
    return cleaned.toDF(*names, *new)


def _bucketed(flat: DataFrame, text_at: int, pack_bytes: int) -> DataFrame:
    """``pack, n_rows, data``: the rows in packs, written once below the shared folder as a table
    bucketed by pack, so that replies join it without moving it. The catalogue does not keep it."""
    spark = flat.sparkSession
    size = int(flat.agg(F.sum(F.octet_length(f"_{text_at}"))).first()[0] or 0)
    # Spark would rather move the packs than go below its number of shuffle partitions
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / pack_bytes / PACKS_IN_BUCKET))
    packed = flat.mapInArrow(_packs(text_at, pack_bytes), "n_rows int, data binary").withColumn("pack", F.monotonically_increasing_id())
    name = f"pairloom_packs_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    packed.write.format("parquet").bucketBy(buckets, "pack").option("path", path).option("compression", "none").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return table


def _with_replies(packs: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Packs with the bits of all levels so far: no more than a few bits for each of their words."""
    if not replies:
        return packs.select("pack", "data", F.lit(None).cast("array<struct<level:int,bucket:int,n:int,bits:binary>>").alias("replies"))
    both = replies[0]
    for more in replies[1:]:
        both = both.union(more)
    own = both.groupBy("pack").agg(F.collect_list(F.struct("level", "bucket", "n", "bits")).alias("replies"))
    return packs.join(own, "pack", "left").select("pack", "data", "replies")
