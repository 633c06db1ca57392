"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import pick, staged, text_or_empty

#: The vocabulary is SIDE groups of SIDE words: a pad, SUFFIXES classes of rarer words by their
#: last letters, and the most frequent words of the corpus.
SIDE, SUFFIXES, WIDTH = 32, 96, 16
#: Neighbours on each side, and positions that are worked on at a time.
REACH, POSITIONS_AT_ONCE = 2, 8192
_PAD = 0
#: Rare words, the most frequent ones, whose probabilities travel with the network; all others meet
#: theirs in a join.
NEAR = 1 << 17


def words_of(text: Column) -> Column:
    """The words of a text, one row each; an empty one where it begins or ends with space."""
    return F.explode(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``w, count, class`` of every word of ``docs(text)``: a table that grows with the corpus."""
    counts = docs.select(words_of(F.col("text")).alias("w")).where("w <> ''").groupBy("w").count()
    return staged(counts.withColumn("class", class_of(F.col("w"))), "words")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> dict[bytes, int]:
    """The most frequent words, by counts over all of ``docs(text)``; as many as SIDE allows reach the driver."""
    counts = word_counts(docs) if counts is None else counts
    top = counts.orderBy(F.desc("count"), "w").limit(SIDE * SIDE - 1 - SUFFIXES).collect()
    # neighbours in frequency are spread over the groups, so that groups weigh about the same
    size = SIDE * SIDE
    places = [i for i in (((k * SIDE) % size) + (k * SIDE) // size for k in range(size)) if i > SUFFIXES]
    return {r["w"].encode(): places[i] for i, r in enumerate(top)}


def class_of(word: Column) -> Column:
    """What :meth:`Ids.class_of` gives."""
    data = F.encode(word, "UTF-8")
    byte = lambda at: F.conv(F.hex(F.substr(data, at, F.lit(1))), 16, 10).cast("int")
    size = F.octet_length(word)
    return 1 + (byte(F.lit(-1)) * 31 + byte(-F.least(size, F.lit(2))) * 7 + F.least(size, F.lit(12))) % SUFFIXES


def rare_words(counts: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """``w, count, log_p`` of the words outside the vocabulary: the probability of a word within its
    class, by counts over the whole corpus plus one, one more for all words never seen."""
    known = counts.sparkSession.createDataFrame([(w.decode("utf-8", "surrogatepass"),) for w in words], "w string")
    rare = counts.join(F.broadcast(known), "w", "left_anti")
    classes = rare.groupBy("class").agg((F.sum("count") + F.count("*") + 1).alias("all"))  # SUFFIXES rows at most
    each = rare.join(F.broadcast(classes), "class")
    return each.select("w", "count", (F.log(F.col("count") + 1) - F.log("all")).alias("log_p"))


def near_words(rare: DataFrame, most: int = NEAR) -> dict[bytes, float]:
    """``log_p`` of the most frequent rare words: all from the least count that no more than ``most``
    of them reach. One row for each count, ``most`` at most, comes to the driver for it."""
    tally = rare.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).limit(most).collect()
    within = int(np.searchsorted(np.cumsum([r["n"] for r in tally]), most, "right"))
    if not within:
        return {}
    found = rare.where(F.col("count") >= tally[within - 1]["count"]).select("w", "log_p").collect()
    return {r["w"].encode(): r["log_p"] for r in found}


def far_words(scored: DataFrame, rare: DataFrame) -> DataFrame:
    """``row, far``: the sum of ``log_p`` over the words in ``scored(row, rest)``."""
    tokens = scored.where("rest <> ''").select("row", F.explode(F.split("rest", " ")).alias("w"))
    return tokens.join(rare.select("w", "log_p"), "w").groupBy("row").agg(F.sum("log_p").alias("far"))


class Ids(dict):
    """Ids of words; a word outside the vocabulary has the class of its end, remembered once found."""

    REMEMBERED = 400_000

    def __missing__(self, word: bytes) -> int:
        found = self.class_of(word)
        if len(self) < self.REMEMBERED:
            self[word] = found
        return found

    @staticmethod
    def class_of(word: bytes) -> int:
        return 1 + (word[-1] * 31 + word[-2:][0] * 7 + min(len(word), 12)) % SUFFIXES


def token_ids(text: str, words: Ids) -> np.ndarray:
    """Ids of the words of a whole text."""
    parts = text.lower().encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(words.__getitem__, parts), np.int16, len(parts))


@dataclass
class Network:
    """Embeddings of each neighbour position, and a softmax over groups and over words in a group."""

    near: np.ndarray  # positions x vocabulary x width
    bias: np.ndarray  # width
    group: np.ndarray  # width x groups
    group_bias: np.ndarray
    word: np.ndarray  # groups x width x words
    word_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        return cls(draw(2 * REACH, SIDE * SIDE, WIDTH), zero(WIDTH), draw(WIDTH, SIDE), zero(SIDE), draw(SIDE, WIDTH, SIDE), zero(SIDE, SIDE))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        model, at, out = cls.fresh(), 0, []
        for f in fields(cls):
            like = getattr(model, f.name)
            out.append(flat[at : at + like.size].reshape(like.shape).astype(np.float32).copy())
            at += like.size
        return cls(*out)

    def _forward(self, ids: np.ndarray, at: np.ndarray):
        """ids: padded stream; at: positions to predict, which no row of its own context sees."""
        around = [ids[at + o] for o in (*range(-REACH, 0), *range(1, REACH + 1))]
        hidden = self.bias + sum(self.near[j][c] for j, c in enumerate(around))
        np.tanh(hidden, out=hidden)
        group, word = np.divmod(ids[at], SIDE)
        p_group = _softmax(hidden @ self.group + self.group_bias)
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(SIDE + 1))
        p_word = np.empty((len(at), SIDE), np.float32)
        for g in range(SIDE):
            rows = order[ends[g] : ends[g + 1]]
            if len(rows):
                p_word[rows] = hidden[rows] @ self.word[g] + self.word_bias[g]
        return around, hidden, group, word, p_group, _softmax(p_word), order, ends

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, _, group, word, p_group, p_word, _, _ = self._forward(ids, at)
        rows = np.arange(len(at))
        return np.log(p_group[rows, group].astype(np.float64) + 1e-12) + np.log(p_word[rows, word].astype(np.float64) + 1e-12)

    def step(self, ids: np.ndarray, at: np.ndarray, seen: Network, rate: float) -> None:
        """One Adagrad step on the mean of -log p; ``seen`` holds the squared gradients."""
        around, hidden, group, word, p_group, p_word, order, ends = self._forward(ids, at)
        rows = np.arange(len(at))
        p_group[rows, group] -= 1
        p_word[rows, word] -= 1
        p_group /= len(at)
        p_word /= len(at)
        back = p_group @ self.group.T
        for g in range(SIDE):
            own = order[ends[g] : ends[g + 1]]
            if len(own):
                wrong, h = p_word[own], hidden[own]
                back[own] += wrong @ self.word[g].T
                _adagrad(self.word[g], h.T @ wrong, seen.word[g], rate)
                _adagrad(self.word_bias[g], wrong.sum(axis=0), seen.word_bias[g], rate)
        _adagrad(self.group, hidden.T @ p_group, seen.group, rate)
        _adagrad(self.group_bias, p_group.sum(axis=0), seen.group_bias, rate)
        back *= 1 - hidden * hidden
        _adagrad(self.bias, back.sum(axis=0), seen.bias, rate)
        for j, context in enumerate(around):
            by_word = np.argsort(context, kind="stable")
            in_order = context[by_word]
            starts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
            used = in_order[starts]
            slope = np.add.reduceat(back[by_word], starts, axis=0)
            squares = seen.near[j][used] + slope * slope
            seen.near[j][used] = squares
            self.near[j][used] -= rate * slope / np.sqrt(squares)


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place. Scores beyond 60 differ from 60 by less than a float32 tells apart."""
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], np.float32))[:, None]
    return x


def _adagrad(weights: np.ndarray, slope: np.ndarray, seen: np.ndarray, rate: float) -> None:
    seen += slope * slope
    weights -= rate * slope / np.sqrt(seen)


def stream(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with pads between, and the positions of their words."""
    gap = np.full(REACH, _PAD, np.int16)
    ids = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = REACH + np.concatenate([[0], np.cumsum(sizes + REACH)[:-1]])
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)]) if len(texts) else np.empty(0, np.int64)
    return ids, at.astype(np.int64)


def _trained(words: dict[bytes, int], start: np.ndarray, rate: float):
    """Train on every word of the documents of a task; its weights go out with their number of words."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, model, seen, n = Ids(words), Network.of(start), Network.of(np.full(len(start), 1e-6)), 0
        for frame in batches:
            ids, at = stream([token_ids(t, known) for t in frame["text"]])
            for i in range(0, len(at), POSITIONS_AT_ONCE):
                model.step(ids, at[i : i + POSITIONS_AT_ONCE], seen, rate)
            n += len(at)
        if n:
            flat = model.flat()
            for i in range(0, len(flat), 4096):
                yield pd.DataFrame({"place": np.arange(i, min(i + 4096, len(flat)), dtype=np.int32), "value": flat[i : i + 4096].astype(np.float64), "n": np.int64(n)})

    return train


def fit(docs: DataFrame, words: dict[bytes, int], passes: int = 1, rate: float = 0.1) -> np.ndarray:
    """Weights trained on every word of ``docs(text)``.

    Each task trains the network on its own documents from the same start; the averages of the
    tasks' weights, by words read, are the start of the next pass. What the tasks send grows
    with the corpus; the driver gets one number per weight.
    """
    flat = Network.fresh().flat()
    for _ in range(passes):
        local = docs.select("text").mapInPandas(_trained(words, flat, rate), "place int, value double, n long")
        mean = (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")
        rows = staged(local.groupBy("place").agg(mean), "weights").collect()
        for r in rows:
            flat[r["place"]] = r["value"]
    return flat


def _sums(model: Network, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the sum of their log-probabilities."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids, at = stream(texts)
    logs = [model.log_probabilities(ids, at[i : i + POSITIONS_AT_ONCE]) for i in range(0, len(at), POSITIONS_AT_ONCE)]
    sums = np.concatenate([[0.0], np.cumsum(np.concatenate(logs) if logs else [])])
    ends = np.cumsum(sizes)
    return sizes, sums[ends] - sums[ends - sizes]


def scores(docs: DataFrame, words: dict[bytes, int], weights: np.ndarray, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, log_likelihood`` of ``docs(doc_id, text)`` under trained weights, where a
    word outside the vocabulary counts as its class."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, weights.astype(np.float32)))

    @F.pandas_udf("n_tokens long, log_likelihood double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, model = Ids(shared.value[0]), Network.of(shared.value[1])
        for texts in batches:
            sizes, sums = _sums(model, [token_ids(t, known) for t in texts])
            yield pd.DataFrame({"n_tokens": sizes, "log_likelihood": sums})

    more = [c for c in docs.columns if c not in (id_column, "text")]
    return docs.select(id_column, *more, of("text").alias("s")).select(id_column, *more, "s.n_tokens", "s.log_likelihood")


def scores_within(docs: DataFrame, words: dict[bytes, int], weights: np.ndarray, near: dict[bytes, float]) -> DataFrame:
    """``row, doc_id, n_tokens, log_likelihood, rest`` of ``docs(doc_id, text)``, one row each, staged.

    A word in ``near`` counts with its probability within its class, any other word outside the
    vocabulary as its class only; these are in ``rest``, with a space between.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, weights.astype(np.float32), list(near), np.array(list(near.values()), float)))

    @F.pandas_udf("n_tokens long, log_likelihood double, rest string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary, flat, near_to, log_p = shared.value
        # codes: ids of the vocabulary, with classes for the rest, then the near words
        known, model, first = Ids(vocabulary), Network.of(flat), SIDE * SIDE
        known.update(zip(near_to, range(first, first + len(near_to))))
        id_of = np.concatenate([np.arange(first), [Ids.class_of(w) for w in near_to]]).astype(np.int16)
        log_of = np.concatenate([np.zeros(first), log_p])
        for texts in batches:
            each, inside, rest = [], [], []
            for text in texts:
                parts = text.encode("utf-8", "surrogatepass").split()
                codes = np.fromiter(map(known.__getitem__, parts), np.int32, len(parts))
                each.append(id_of[codes])
                inside.append(log_of[codes].sum())
                rest.append(b" ".join([parts[i] for i in np.flatnonzero(codes <= SUFFIXES)]).decode("utf-8", "surrogatepass"))
            sizes, sums = _sums(model, each)
            yield pd.DataFrame({"n_tokens": sizes, "log_likelihood": sums + np.array(inside, float), "rest": rest})

    scored = docs.select("doc_id", of(F.lower("text")).alias("s"))
    return staged(scored.select(F.monotonically_increasing_id().alias("row"), "doc_id", "s.*"), "scored")


def pseudo_likelihood(docs: DataFrame, passes: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, log_likelihood, mean_log_likelihood``.

    Every word of a whole text is masked in turn and predicted from two words on each side by
    a network trained on all of ``docs``; log_likelihood is the sum of the log-probabilities. A
    word outside the network's vocabulary has the probability of its class times that of the
    word within the class, by counts of all words of ``docs`` (:func:`rare_words`).

    Null and empty texts have no tokens, log_likelihood 0 and a null mean. Repeated rows get
    equal scores up to rounding, null ids are kept, an empty table gives an empty result.
    """
    own = pick(docs, doc_id=id_column, text=text_column).withColumn("text", text_or_empty())
    counts = word_counts(own)
    words = vocabulary(own, counts)
    weights = fit(own, words, passes)
    rare = rare_words(counts, words)
    scored = scores_within(own, words, weights, near_words(rare))
    both = F.col("log_likelihood") + F.coalesce("far", F.lit(0.0))
    scored = scored.join(far_words(scored, rare), "row", "left").select("doc_id", "n_tokens", both.alias("log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.withColumn("mean_log_likelihood", mean)
