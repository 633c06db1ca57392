"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import give_back_memory, kept_in_worker, pick, text_or_empty, with_columns_of

SPACE = "▁"
#: A run of spaces with the word after it: no piece holds a line feed, or a space after a letter.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: The same, with letters and other characters apart. Fits models whose pieces never mix them.
_SCRIPTS = re.compile(f"{SPACE}*(?:[^\\W\\d_¹²³]+|(?:[^{SPACE}\n\\w]|[\\d_¹²³])+)|{SPACE}+|\n")
#: Chunks of words that a worker remembers, cut without dropout: the first it meets, among which
#: are the frequent ones.
MOST_CHUNKS = 200_000
_MASK = (1 << 64) - 1
#: Characters of a chunk whose agenda is a plain list; the rank of a pair that is no piece.
SHORT, _NEVER = 24, 1 << 62


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ODD, _PLACE, _LENGTH = 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _turn(place: int, size: int) -> int:
    x = (place * _PLACE + size * _LENGTH) & _MASK
    return x ^ (x >> 29)


def _mixed(base: int, place: int, size: int) -> int:
    """32 bits for a candidate: keyed by ``base`` (of one chunk), its place and size."""
    return ((base ^ _turn(place, size)) * _ODD & _MASK) >> 32


#: The same by table, for short chunks.
_TURNS = [[_turn(place, size) for size in range(SHORT + 1)] for place in range(SHORT)]


_TURN_TABLE = np.array(_TURNS, np.uint64)
_NO_PAIR = (1 << 31) - 1
#: Bits of a slot in the table of pairs.
SLOT_BITS = 19
#: Texts, and about how many characters, that are encoded together; chunks that are merged together.
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE, CHUNKS_AT_ONCE = 1024, 3_000_000, 16384


def _bases(keys: list[int], counts: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash for each chunk of each text: of the seed, the text's key and the place."""
    own = np.array([xxhash.xxh64_intdigest((k & _MASK).to_bytes(8, "little"), seed & _MASK) for k in keys], np.uint64)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    x = np.repeat(own, counts) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_PLACE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _any_skipped(base: np.ndarray, of: np.ndarray, turns: list[bytes], dropped: int) -> np.ndarray:
    """Whether any of the turns of chunk ``of[i]`` is skipped under ``base[i]``."""
    flat = np.frombuffer(b"".join(turns), np.uint64)
    size = np.array([len(t) // 8 for t in turns])
    start = np.cumsum(size) - size
    skipped = np.zeros(len(of), bool)
    live = np.arange(len(of))
    for turn in range(size.max()):
        live = live[size[of[live]] > turn]
        mixed = (base[live] ^ flat[start[of[live]] + turn]) * np.uint64(_ODD)
        skip = (mixed >> np.uint64(32)).astype(np.int64) < dropped
        skipped[live[skip]] = True
        live = live[~skip]
        if not len(live):
            break
    return skipped


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(_PLACE)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class _Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key):
        self[key] = found = len(self)
        return found


class Pieces:
    """The pieces of a BPE model with byte fallback: ids and ranks for merging, bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.bytes: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                self.bytes.append(piece.replace(SPACE, " ").encode())
        # merges go by score, best first; the score falls with the id
        self.rank = {p: -round(model.get_score(i)) for p, i in self.ids.items()}
        self._tables()
        one = lambda p: _SCRIPTS.fullmatch(p) or len(p) == 1
        self.chunks = (_SCRIPTS if all(map(one, self.ids)) else _WORDS).findall
        self.known: dict[str, tuple[bytes, bytes, int]] = {}

    def _tables(self) -> None:
        """Arrays for merging many chunks together: symbol of each character, turn of each pair
        (its place in the order of scores), and the symbol made and its length by turn. Symbols
        are ids; a character that is no piece has a symbol above all."""
        count = len(self.bytes)
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (self.rank[p], self.ids[p]))
        turn_of = {p: i for i, p in enumerate(order)}
        # pieces of equal score go by place, which only the one-by-one forms know
        equal = [p for p, q in zip(order, order[1:] + order[:1]) if self.rank[p] == self.rank[q]]
        self.tied = re.compile("|".join(map(re.escape, equal))) if equal else None
        self.made = np.array([self.ids[p] for p in order], np.int32)
        self.lengths = np.array([len(p) for p in order], np.int64)
        self.symbol_of = np.arange(count, count + 0x110000, dtype=np.int32)
        pairs = []
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, turn_of[piece]))
        pairs.sort()
        # pairs by hashed slot; those that share a slot are looked up among the sorted keys
        self.pair_keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.pair_turn = np.array([i for _, i in pairs] + [_NO_PAIR], np.int32)
        slots = _slots(self.pair_keys[:-1])
        self.slot_key, self.slot_turn = np.full(1 << SLOT_BITS, -1), np.full(1 << SLOT_BITS, _NO_PAIR, np.int32)
        self.slot_key[slots], self.slot_turn[slots] = self.pair_keys[:-1], self.pair_turn[:-1]
        self.slot_key[np.flatnonzero(np.bincount(slots, minlength=1) > 1)] = -2
        sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_size, self.byte_start = sizes, np.cumsum(sizes) - sizes
        self.byte_pool = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _turns(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = _slots(key)
        held = self.slot_key[slot]
        turns = np.where(held == key, self.slot_turn[slot], np.int32(_NO_PAIR))
        shared = held == -2
        if shared.any():
            at = np.searchsorted(self.pair_keys, key[shared])
            turns[shared] = np.where(self.pair_keys[at] == key[shared], self.pair_turn[at], np.int32(_NO_PAIR))
        return turns

    def _alone(self, chunk: str) -> bool:
        """Whether a chunk takes its turns by itself: long ones, and those that hold pieces of
        equal score."""
        return not 1 < len(chunk) <= SHORT or bool(self.tied and self.tied.search(chunk))

    def _segments(self, chunks: list[str]) -> list[tuple[bytes, bytes, int]]:
        """For each chunk, without dropout, its ids as int32 bytes, the turns it took as uint64
        bytes, and its length. Short chunks of one length take their turns together, each with the best
        candidate of its own agenda; for one that goes by itself the length is given as 0."""
        found: list = [None] * len(chunks)
        by_length: dict[int, list[int]] = {}
        for i, chunk in enumerate(chunks):
            if self._alone(chunk):
                turns: list[int] = []
                ids = self._ids(self._merged(chunk, 0, 0, turns))
                found[i] = array("i", ids).tobytes(), np.array(turns, np.uint64).tobytes(), 0
            else:
                by_length.setdefault(len(chunk), []).append(i)
        for length, places in by_length.items():
            for at in range(0, len(places), CHUNKS_AT_ONCE):
                own = places[at : at + CHUNKS_AT_ONCE]
                symbols, size, taken = self._take_turns(self._symbols([chunks[i] for i in own], length), None, 0)
                of = np.concatenate([r for r, _ in taken])
                order = np.argsort(of, kind="stable")
                steps = np.cumsum(np.bincount(of, minlength=len(own))) * 8
                turns_of = np.concatenate([t for _, t in taken])[order].tobytes()
                ids, sizes = self._ids_of(symbols, size)
                data, ends = ids.tobytes(), (np.cumsum(sizes) * 4).tolist()
                steps = steps.tolist()
                for i, x, y, u, v in zip(own, [0, *ends], ends, [0, *steps], steps):
                    found[i] = data[x:y], turns_of[u:v], length
        return found

    def _drawn(self, chunks: list[str], lengths: np.ndarray, of: np.ndarray, base: np.ndarray, dropped: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Chunk ``of[i]`` cut with dropout under ``base[i]``: arrays of ids, which count as one
        array, and where in it each one starts and how many ids it has. ``lengths`` of the
        chunks are those that :meth:`_segments` gives."""
        start, many = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        out: list[np.ndarray] = []
        total = 0
        for length in np.unique(lengths[of]).tolist():
            places = np.flatnonzero(lengths[of] == length)
            if length:
                numbers, row = np.unique(of[places], return_inverse=True)
                symbols = self._symbols([chunks[i] for i in numbers.tolist()], length)
            for at in range(0, len(places), CHUNKS_AT_ONCE):
                own = places[at : at + CHUNKS_AT_ONCE]
                if length:
                    ids, sizes = self._ids_of(*self._take_turns(symbols[row[at : at + CHUNKS_AT_ONCE]], base[own], dropped)[:2])
                else:
                    each = [self._ids(self._merged(chunks[c], b, dropped, [])) for c, b in zip(of[own].tolist(), base[own].tolist())]
                    ids, sizes = np.array([x for own_ids in each for x in own_ids], np.int32), np.array([len(x) for x in each], np.int64)
                start[own], many[own] = total + np.cumsum(sizes) - sizes, sizes
                out.append(ids)
                total += len(ids)
        return out, start, many

    def _symbols(self, chunks: list[str], length: int) -> np.ndarray:
        """One row of symbols for each of the chunks, which all have this length."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.symbol_of[points.reshape(-1, length)]

    def _take_turns(self, symbols: np.ndarray, base: np.ndarray | None, dropped: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Merges every row of ``symbols`` in place; how many symbols are left of each row, and
        without dropout the turns taken, as (rows, turns) step by step."""
        many, length = symbols.shape
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        column = np.arange(length)
        places = np.tile(column.astype(np.int8), (many, 1))
        agenda = np.full(symbols.shape, _NO_PAIR, np.int32)
        agenda[:, :-1] = self._turns(symbols[:, :-1], symbols[:, 1:])
        size = np.full(many, length)
        rows = np.arange(many)
        while len(rows):
            at = agenda[rows].argmin(axis=1)
            best = agenda[rows, at]
            going = best < _NO_PAIR
            rows, at, best = rows[going], at[going], best[going]
            if dropped and len(rows):
                mixed = (base[rows] ^ _TURN_TABLE[places[rows, at], self.lengths[best]]) * np.uint64(_ODD)
                skip = (mixed >> np.uint64(32)).astype(np.int64) < dropped
                agenda[rows[skip], at[skip]] = _NO_PAIR
                moved, at, best = rows[~skip], at[~skip], best[~skip]
            else:
                moved = rows
                taken.append((rows, _TURN_TABLE[places[rows, at], self.lengths[best]]))
            if not len(moved):
                continue
            # the right half of each merged pair goes, what follows it moves up by one
            symbols[moved, at] = self.made[best]
            row, beyond = (moved * length)[:, None], at[:, None]
            after = row + np.minimum(column + (column > beyond), length - 1)
            own, place = symbols.ravel().take(after), places.ravel().take(after)
            wish = agenda.ravel().take(row + np.minimum(column + (column >= beyond), length - 1))
            wish[:, -1] = _NO_PAIR
            size[moved] -= 1
            line = np.arange(len(moved))
            right = at + 1 < size[moved]
            wish[line, at] = _NO_PAIR
            wish[line[right], at[right]] = self._turns(own[line[right], at[right]], own[line[right], at[right] + 1])
            left = at > 0
            wish[line[left], at[left] - 1] = self._turns(own[line[left], at[left] - 1], own[line[left], at[left]])
            symbols[moved], places[moved], agenda[moved] = own, place, wish
        return symbols, size, taken

    def _ids_of(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of merged rows, one row after the other, and how many each row has. Symbols that
        are no piece become the ids of their bytes."""
        count = len(self.bytes)
        flat = symbols[np.arange(symbols.shape[1]) < size[:, None]]
        odd = np.flatnonzero(flat >= count)
        if not len(odd):
            return flat, size
        out, made, done = [], size.copy(), 0
        row = np.repeat(np.arange(len(size)), size)
        for i in odd.tolist():
            own = [self.byte_ids[b] for b in chr(int(flat[i]) - count).encode("utf-8", "surrogatepass")]
            out += [flat[done:i], np.array(own, np.int32)]
            made[row[i]] += len(own) - 1
            done = i + 1
        return np.concatenate([*out, flat[done:]]), made

    def segment(self, chunk: str, key: int, dropped: int) -> list[int]:
        """Merge the characters of a chunk, best candidate first. A candidate whose turn has
        come is skipped for good if its keyed hash is below ``dropped`` (of 2**32)."""
        return self._ids(self._merged(chunk, xxhash.xxh64_intdigest(chunk.encode(), key) if dropped else 0, dropped, []))

    def _merged(self, chunk: str, base: int, dropped: int, turns: list[int]) -> list[str]:
        """The symbols of a chunk; adds the turns taken, skipped ones included, to ``turns``."""
        return (self._by_list if len(chunk) <= SHORT else self._by_agenda)(chunk, base, dropped, turns)

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            out.extend([i] if i is not None else [self.byte_ids[b] for b in s.encode()])
        return out

    def _by_list(self, chunk: str, base: int, dropped: int, turns: list[int]) -> list[str]:
        """For a short chunk the agenda is a list with the rank of each neighbouring pair."""
        symbols, places, get = list(chunk), list(range(len(chunk))), self.rank.get
        agenda = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:  # an exhausted list has no candidate below _NEVER
            best = min(agenda)
            if best == _NEVER:
                break
            at = agenda.index(best)
            merged = symbols[at] + symbols[at + 1]
            turns.append(_TURNS[places[at]][len(merged)])
            if dropped and ((base ^ _TURNS[places[at]][len(merged)]) * _ODD & _MASK) >> 32 < dropped:
                agenda[at] = _NEVER
                continue
            symbols[at] = merged
            del symbols[at + 1], places[at + 1], agenda[at]
            if at < len(agenda):
                agenda[at] = get(merged + symbols[at + 1], _NEVER)
            if at:
                agenda[at - 1] = get(symbols[at - 1] + merged, _NEVER)
        return symbols

    def _by_agenda(self, chunk: str, base: int, dropped: int, turns: list[int]) -> list[str]:
        """For a long chunk it is a heap; entries whose pair has changed since are passed over."""
        symbols: list[str] = list(chunk)
        last = len(symbols)
        before, after = list(range(-1, last - 1)), list(range(1, last + 1))
        rank = self.rank
        agenda = [(r, i, i + 1, 2) for i in range(last - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            turns.append(_turn(left, size))
            if dropped and _mixed(base, left, size) < dropped:
                continue
            symbols[left] = a + b
            symbols[right] = ""
            following = after[left] = after[right]
            if following < last:
                before[following] = left
                if (s := rank.get(a + b + symbols[following])) is not None:
                    heapq.heappush(agenda, (s, left, following, size + len(symbols[following])))
            previous = before[left]
            if previous >= 0 and (s := rank.get(symbols[previous] + a + b)) is not None:
                heapq.heappush(agenda, (s, previous, left, size + len(symbols[previous])))
        return [s for s in symbols if s]

    def encode(self, text: str, seed: int, key: int, dropped: int) -> np.ndarray:
        """Ids of a text (int32)."""
        return next(self.encode_all([text], [key], seed, dropped))

    def encode_all(self, texts: list[str], keys: list[int], seed: int, dropped: int) -> Iterator[np.ndarray]:
        """Ids of many texts, one after the other. Every chunk of a text has dropout of its own,
        keyed by the seed, the text's key and the place of the chunk in the text."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and end - at < TEXTS_AT_ONCE and (end == at or size + len(texts[end]) <= CHARACTERS_AT_ONCE):
                size, end = size + len(texts[end]), end + 1
            yield from self._encode_together(texts[at:end], keys[at:end], seed, dropped)
            at = end

    def _encode_together(self, texts: list[str], keys: list[int], seed: int, dropped: int) -> list[np.ndarray]:
        """A chunk takes the same turns as without dropout until one is skipped. So chunks are cut
        without dropout once, the skips are drawn for these turns at each place, and only
        where one is skipped does the chunk take its turns again. A space mark that stands in
        a text itself (None among the chunks) goes out as bytes."""
        number = _Numbers({None: 0})
        rows = []
        for text in texts:
            found: list[str | None] = []
            for n, part in enumerate(text.split(SPACE) if text else ()):
                found += [None] * (n > 0)
                found += self.chunks((SPACE if n == 0 else "") + part.replace(" ", SPACE))
            rows.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        chunks = list(number)
        of = np.concatenate(rows)
        counts = np.array([len(r) for r in rows])
        known = [(array("i", [self.byte_ids[b] for b in SPACE.encode()]).tobytes(), b"", 0), *self._without_dropout(chunks[1:])]
        pool = [np.frombuffer(b"".join([k[0] for k in known]), np.int32)]
        size = np.array([len(k[0]) // 4 for k in known])
        start = (np.cumsum(size) - size)[of]
        size = size[of]
        if dropped and len(of):
            base = _bases(keys, counts, seed)
            hit = np.flatnonzero(_any_skipped(base, of, [k[1] for k in known], dropped))
            again, begin, size[hit] = self._drawn(chunks, np.array([k[2] for k in known]), of[hit], base[hit], dropped)
            start[hit] = len(pool[0]) + begin
            pool += again
        ends = np.cumsum(size)
        ids = np.concatenate(pool)[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(ids, np.r_[0, ends][np.cumsum(counts)[:-1]])

    def _without_dropout(self, chunks: list[str]) -> list[tuple[bytes, bytes, int]]:
        """What :meth:`_segments` gives, from memory where there."""
        unseen = [c for c in chunks if c not in self.known]
        fresh = dict(zip(unseen, self._segments(unseen)))
        found = [self.known[c] if c in self.known else fresh[c] for c in chunks]
        self.known.update(islice(fresh.items(), max(0, MOST_CHUNKS - len(self.known))))
        return found

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        size = self.byte_size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.byte_start[ids] - ends + size, size) + np.arange(ends[-1] if len(ids) else 0)
        text = self.byte_pool[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(text: Column, key: Column, path: str, dropout: float = 0.1, seed: int = 0) -> Column:
    """Column of piece ids. ``key`` (any long) and the place in the text key the skips, so equal
    words differ between texts and within one, and a text's ids depend on nothing but seed, key
    and text. Another seed gives other segmentations, as for each pass of a training over a corpus."""
    dropped = round(dropout * 2**32)

    @F.pandas_udf("array<int>")
    def of(texts: pd.Series, keys: pd.Series) -> pd.Series:
        own = kept_in_worker(f"pieces {path}", lambda: Pieces(path))
        return pd.Series(list(own.encode_all(texts.tolist(), keys.tolist(), seed, dropped)), dtype=object)

    return of(text, F.xxhash64(key))


def encode_checked(rows: DataFrame, key: Column, path: str, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """``rows`` (with a column ``text`` that has no nulls) and the columns ``ids``, ``n_bytes`` (of
    the text that the ids decode to) and ``lossless``.

    Each text is decoded and compared where it was encoded. Rows go through in slices of
    ``TEXTS_AT_ONCE``, so a task holds the ids and copies of no more texts than that.
    """
    dropped = round(dropout * 2**32)

    def code(batches):
        own = kept_in_worker(f"pieces {path}", lambda: Pieces(path))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part.column("text").to_pylist()
                ids, sizes, same = [], [], []
                for text, coded in zip(texts, own.encode_all(texts, part.column("key").to_pylist(), seed, dropped)):
                    back = own.decode(coded)
                    ids.append(coded)
                    sizes.append(len(back.encode("utf-8", "surrogatepass")))
                    same.append(back == text)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                more = [lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())]
                kept = [n for n in part.schema.names if n != "key"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *more], [*kept, "ids", "n_bytes", "lossless"])
        # the model stays with the worker, the chunks go with the task
        own.known.clear()
        give_back_memory()

    keyed = rows.withColumn("key", F.xxhash64(key))
    made = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_bytes", T.LongType()), T.StructField("lossless", T.BooleanType())])
    return keyed.mapInArrow(code, made)


def decode(ids: Column, path: str) -> Column:
    """Column of the texts that ids stand for; a null array is an empty text."""

    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        own = kept_in_worker(f"pieces {path}", lambda: Pieces(path))
        return pd.Series([own.decode(ids if ids is not None else ()) for ids in batch], dtype=object)

    return of(ids)


def sampled_pieces(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, ids, n_pieces, n_bytes_decoded, lossless``.

    Byte-pair merges of the model run best score first from an agenda; with probability
    ``dropout`` a candidate is skipped, decided by a hash keyed by seed, the document's
    id, the word's place in the text, and the candidate's place and size. dropout=0 gives the library's own pieces.
    lossless tells that decoding the ids gave back the whole text.

    Null and empty texts have no ids and decode to an empty text. Repeated rows get equal
    ids. Null ids share a key. Marks that stand for spaces inside a text go out
    as bytes, so they come back as themselves. An empty table gives an empty result.
    """
    own = pick(docs, doc_id=id_column, text=text_column).withColumn("text", text_or_empty())
    coded = encode_checked(own, F.col("doc_id").cast("long"), path, dropout, seed)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.col("n_bytes").alias("n_bytes_decoded"), "lossless")


def with_pieces(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", ids_name: str = "piece_ids") -> DataFrame:
    """``docs`` with a last column of piece ids (a null text has an empty array). A column that
    has this name already stays as it is and the new one is numbered.

    Raises, in the job, if an encoding does not decode to its whole text.
    """
    flat, own = with_columns_of(docs, doc_id=id_column, text=text_column)
    plain = flat.withColumn("text", text_or_empty())
    coded = encode_checked(plain, F.xxhash64("doc_id"), path, dropout, seed)
    sure = F.when(F.col("lossless"), F.col("ids")).otherwise(F.raise_error(F.lit("pieces do not decode to their text")).cast("array<int>"))
    name, taken = ids_name, {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_1"
    return coded.select(*own, sure.alias("ids")).toDF(*docs.columns, name)
