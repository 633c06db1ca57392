"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import pick, renamed_back, staged, text_or_empty, with_columns_of

#: Lengths of the character n-grams, border marks included; hash buckets (a power of two).
SIZES, BUCKETS = (3, 4, 5), 1 << 18
#: Labelled rows of each class that the model is fitted on, at most; chosen by hash.
FIT_ROWS = 4000
#: Neutral words that every average holds besides the text's own, so that one odd n-gram does
#: not decide a text of a few words.
NEUTRAL_WORDS = 25
#: Characters of a long text that are worked on at a time (cut at a word border).
CHARACTERS_AT_ONCE = 1 << 20

_BORDER = 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, with every run of other characters than letters, digits and
    the marks of obfuscated words turned into borders, and one border at each end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    small = _WORD[np.minimum(points, 255)]
    keep = np.where(points > 255, True, small)
    out = np.empty(len(points) + 2, np.uint32)
    out[0] = out[-1] = _BORDER
    out[1:-1] = np.where(keep, points, _BORDER)
    return out


_WORD = np.array([chr(i).isalnum() or chr(i) in "'@$" for i in range(256)])


def ngrams(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of all n-grams of all words, the weight of each, and the number of words.

    A word weighs one, shared evenly by its n-grams; n-grams stay inside a word and its two
    border marks. A word too short for any n-gram counts with its marks as one.
    """
    code = _codes(text)
    border = code == _BORDER
    inner = np.concatenate([[0], np.cumsum(~border)])
    start_of_word = border[:-1] & ~border[1:]
    words = int(start_of_word.sum())
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float64), 0
    # number of the word that a window from i belongs to: windows start at a border or inside
    word = np.cumsum(np.concatenate([start_of_word, [False]])) - 1
    found, owner = [], []
    mixed = np.zeros(len(code), np.uint64)
    for length in range(1, max(SIZES) + 1):
        n = len(code) - length + 1
        if n <= 0:
            break
        mixed = (mixed[:n] ^ code[length - 1 :]) * _STEP
        mixed ^= mixed >> np.uint64(29)
        if length not in SIZES:
            continue
        # no border strictly inside, and at least one letter
        whole = inner[length - 1 : length - 1 + n] - inner[1 : n + 1] == length - 2
        at = np.flatnonzero(whole)
        found.append(mixed[at] ^ np.uint64(length))
        owner.append(word[at])
    keys = np.concatenate(found)
    owners = np.concatenate(owner)
    keys ^= keys >> np.uint64(32)
    each = np.bincount(owners, minlength=words)
    weight = 1.0 / np.maximum(each, 1)
    return (keys & np.uint64(buckets - 1)).astype(np.int64), weight[owners], words


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that end at white space, where there is any."""
    at = 0
    while len(text) - at > CHARACTERS_AT_ONCE:
        cut = text.rfind(" ", at, at + CHARACTERS_AT_ONCE)
        cut = cut if cut > at else at + CHARACTERS_AT_ONCE
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Model:
    """What scoring needs of the trained model: embeddings times the difference of the two
    softmax columns is one number per bucket, and the average of a bag is linear in them."""

    toward: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        total, words = 0.0, 0
        for part in _pieces(text):
            keys, weight, n = ngrams(part, len(self.toward))
            total += float(self.toward[keys] @ weight) if n else 0.0
            words += n
        return float(1 / (1 + np.exp(-np.clip(total / (words + NEUTRAL_WORDS) + self.bias, -500, 500))))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, width: int = 8, steps: int = 1200, rate: float = 1.0, shrink: float = 4e-6, seed: int = 7) -> Model:
    """Train embeddings (bucket x width) and softmax (width x 2) together by Adagrad.

    bags: per text the distinct buckets and their shares (with the neutral words' summing to 1). Both classes weigh
    the same, at any number of rows the same number of steps is made. ``shrink`` pulls each n-gram's embedding towards zero, so those that tell nothing
    stay neutral instead of fitting chance. Without a text of either class the score is the share of label 1 (0.0 if none).
    """
    labels = np.asarray(labels, np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(buckets, np.float32), 40.0 if share else -40.0)
    rng = np.random.default_rng(seed)
    embed = np.zeros((buckets, width), np.float32)  # an n-gram that was never seen stays neutral
    soft, bias = rng.normal(0, 0.1, (width, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_embed, seen_soft, seen_bias = np.full(buckets, 1e-8, np.float32), np.full_like(soft, 1e-8), np.full(2, 1e-8, np.float32)
    balance = np.array([0.5 / (1 - share), 0.5 / share], np.float32)
    sizes = np.array([len(k) for k, _ in bags])
    batch = 64
    order = np.empty(0, np.int64)
    for _ in range(steps):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(bags))])
        rows, order = order[:batch], order[batch:]
        keys = np.concatenate([bags[i][0] for i in rows])
        share_of = np.concatenate([bags[i][1] for i in rows]).astype(np.float32)
        row = np.repeat(np.arange(len(rows)), sizes[rows])
        used, place = np.unique(keys, return_inverse=True)
        matrix = np.zeros((len(rows), len(used)), np.float32)
        matrix[row, place] = share_of
        own = embed[used]
        hidden = matrix @ own
        logit = hidden @ soft + bias
        logit -= logit.max(axis=1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=1, keepdims=True)
        wrong = p
        wrong[np.arange(len(rows)), labels[rows]] -= 1
        wrong *= (balance[labels[rows]] / len(rows))[:, None]
        to_soft, to_bias, to_hidden = hidden.T @ wrong, wrong.sum(axis=0), wrong @ soft.T
        to_embed = matrix.T @ to_hidden
        seen_embed[used] += (to_embed * to_embed).mean(axis=1)
        step = (rate / np.sqrt(seen_embed[used]))[:, None]
        own = own - step * to_embed
        length = np.sqrt((own * own).sum(axis=1, keepdims=True))
        embed[used] = own * np.maximum(0, 1 - step * shrink / np.maximum(length, 1e-12))
        seen_soft += to_soft * to_soft
        soft -= rate * 0.2 * to_soft / np.sqrt(seen_soft)
        seen_bias += to_bias * to_bias
        bias -= rate * 0.2 * to_bias / np.sqrt(seen_bias)
    return Model((embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def bag_of(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares of it."""
    sums: list[tuple[np.ndarray, np.ndarray]] = []
    words = 0
    for part in _pieces(text):
        keys, weight, n = ngrams(part, buckets)
        words += n
        sums.append((keys, weight))
    keys, place = np.unique(np.concatenate([k for k, _ in sums]), return_inverse=True)
    share = np.bincount(place, np.concatenate([w for _, w in sums]), minlength=len(keys)) / (words + NEUTRAL_WORDS)
    return keys, share


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> Model:
    """Fit on ``docs(doc_id, text)`` that ``labels(doc_id, label)`` marks 0 or 1.

    Of each class the ``fit_rows`` labels lowest by hash are used (a documented bound), so what
    is broadcast and what reaches the driver are bounded, and no text is shuffled. An id with
    several labels counts as 1 if any of them is 1; null ids and labels are left out.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for v in (0, 1)]
    chosen = staged(chosen[0].unionByName(chosen[1]), "chosen")
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            each = [bag_of(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "label": frame["label"],
                    "keys": [k.astype(np.int32).tobytes() for k, _ in each],
                    "shares": [s.astype(np.float32).tobytes() for _, s in each],
                }
            )

    # the bags come one part at a time, so the driver's JVM never holds them all
    rows = staged(texts.mapInPandas(bags, "doc_id long, label int, keys binary, shares binary"), "bags").toLocalIterator()
    found = [(r["doc_id"], bytes(r["keys"]), r["label"], bytes(r["shares"])) for r in rows]
    found.sort(key=lambda r: r[:3])
    return fit([(np.frombuffer(k, np.int32), np.frombuffer(s, np.float32)) for _, k, _, s in found], np.array([r[2] for r in found]), **options)


def scores(text_column: str, model: Model, spark):
    """Column of scores between 0 and 1. The model (one number per bucket) is broadcast."""
    shared = spark.sparkContext.broadcast((model.toward, model.bias))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([Model(*shared.value).score(t) for t in texts], dtype="float64")

    return of(text_or_empty(text_column))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", fit_rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Words are split into hashed character n-grams; a text is the average of its words, a word
    the average of its n-grams' embeddings, and a linear softmax on top tells label 1 from 0.
    Embeddings and softmax are trained together on labelled rows whose crc32(id as text) mod 3
    is not 1; the others are held out. Only text enters a score.

    Null and empty texts are scored like a text without words. A null id is not held out and
    never trained on. Repeated rows get equal scores. No labels, or one class only: the score
    is that class for all rows (0 without labels). No documents: an empty result.
    """
    own = pick(docs, doc_id=id_column, text=text_column).withColumn("text", text_or_empty())
    marks = pick(labels, doc_id=id_column, label=label_column).withColumn("label", F.col("label").cast("int"))
    model = fit_on(own, marks.where(~_held_out()), fit_rows)
    scored = own.select("doc_id", _held_out().alias("held_out"), scores("text", model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns and their order stay.
    Fitted as in :func:`toxicity`, on the labelled rows that are not held out."""
    flat, own = with_columns_of(docs, doc_id=id_column, text=text_column)
    marks = pick(labels, doc_id=id_column, label=label_column).withColumn("label", F.col("label").cast("int"))
    known = pick(docs, doc_id=id_column, text=text_column).withColumn("text", text_or_empty())
    model = fit_on(known, marks.where(~_held_out()), fit_rows)
    return renamed_back(flat.where(scores("text", model, docs.sparkSession) < threshold), own, docs.columns)
