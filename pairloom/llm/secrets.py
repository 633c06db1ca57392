"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary ones.

Everything on the way from a text to its spans is a column expression.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.arrays import bound, running_total
from pairloom.llm.common import pick, renamed_back, staged, text_or_empty, with_columns_of

# Fixed values of the base scan: kind, pattern, and the shortest match that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: The span that the models add: a run of this alphabet, at least this long.
CANDIDATE, SHORTEST = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Labelled strings of each class that the models are trained on, at most; chosen by hash.
FIT_ROWS = 20_000
#: Mean log-likelihood ratio per character from which a candidate is a secret: above zero the
#: random model fits better; trained on alphabets that differ, ordinary words are far below.
THRESHOLD = 0.7
#: First character of the models' alphabet and its size (plus, minus, digits, letters and between).
_FIRST, _SIZE = 43, 80


def _pieces(text: Column, pattern: str) -> Column:
    """Every match of a pattern as ``struct(start, end)`` in code points, end exclusive.

    The text between matches and the matches alternate, so a match starts where the lengths of
    all pieces before it end.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    pair = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    placed = lambda own: F.zip_with(
        own, running_total(F.transform(own, lambda p: p["b"] + p["m"])), lambda p, end: F.struct((end - p["m"]).alias("start"), end.alias("end"))
    )
    return F.when(F.size(found) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(bound(pair, placed))


def _kind(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end>>`` in order of start, then kind.

    ``assign`` matches are found first and those with a short value dropped after, as a dropped
    match still covers its characters. For ``access`` and ``hex`` a match always runs to the
    end of its alphabet, so asking for the length in the pattern finds the same.
    """
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), F.length)
    assign = F.filter(F.zip_with(_pieces(text, ASSIGN), values, lambda s, v: s.withField("v", v)), lambda s: s["v"] >= 6)
    return F.array_sort(F.concat(_kind(assign, 0), _kind(_pieces(text, ACCESS), 1), _kind(_pieces(text, HEX), 2)))


def _bigrams(value: Column) -> Column:
    """Place of each pair of neighbouring characters in a model's table."""
    code = lambda i: F.ascii(F.substring(value, i, F.lit(1))) - _FIRST
    return F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: code(i) * _SIZE + code(i + 1))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character transitions, from ``samples(value, label)``.

    label 1: random strings, 0: ordinary identifiers; values in the alphabet of CANDIDATE.
    Both chains are add-one smoothed. At most ``_SIZE`` squared counts reach the driver. A
    class without samples is uniform; without any samples every ratio is zero.
    """
    pairs = samples.where(F.length("value") >= 2).select("label", F.explode(_bigrams(F.col("value"))).alias("place"))
    counts = pairs.groupBy("label", "place").count().collect()
    table = [[1.0] * (_SIZE * _SIZE) for _ in range(2)]
    for r in counts:
        table[r["label"]][r["place"]] += r["count"]
    out = []
    for row in range(_SIZE):
        cut = slice(row * _SIZE, (row + 1) * _SIZE)
        total = [sum(table[label][cut]) for label in (0, 1)]
        out += [math.log(r / total[1]) - math.log(o / total[0]) for o, r in zip(table[0][cut], table[1][cut])]
    return out


def samples_from(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Labelled strings out of documents: values that the base scan marks are random (1), words
    of documents without any are ordinary (0). Lowest by hash, ``fit_rows`` values and the words
    of a twentieth as many documents are taken: a documented bound of the training only."""
    text = F.col("text")
    marked = F.concat(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    random = docs.select(F.explode(marked).alias("value")).distinct().orderBy(F.xxhash64("value")).limit(fit_rows)
    # a random string may be written in either case
    random = random.select(F.explode(F.array(F.col("value"), F.upper("value"), F.lower("value"))).alias("value")).distinct()
    # hashes choose the documents, so no task gathers texts of every partition
    ordinary = docs.where(~text.rlike(f"{ACCESS}|{HEX}")).select(F.xxhash64("text").alias("h"), "text")
    chosen = staged(ordinary.select("h").distinct().orderBy("h").limit(fit_rows // 20), "chosen")
    plain = ordinary.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    words = plain.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z_-]{4,}"), F.lit(0))).alias("value"))
    joined = words.select(F.explode(F.array(F.col("value"), F.lower("value"), F.upper("value"))).alias("value"))
    return random.select("value", F.lit(1).alias("label")).unionByName(joined.select("value", F.lit(0).alias("label")))


def markov_spans(text: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    """Candidates whose mean log-likelihood ratio per transition is ``threshold`` or more."""
    weights = F.from_json(F.lit(json.dumps([round(r, 6) for r in ratios])), "array<double>")
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    mean = lambda v: F.aggregate(_bigrams(v), F.lit(0.0), lambda acc, place: acc + F.get(weights, place)) / (F.length(v) - 1)
    scored = F.zip_with(_pieces(text, CANDIDATE), F.transform(found, mean), lambda s, m: s.withField("m", m))
    return F.when(text.rlike(CANDIDATE), F.filter(scored, lambda s: s["m"] >= threshold)).otherwise(F.array().cast("array<struct<start:int,end:int,m:double>>"))


def with_spans(docs: DataFrame, text: str, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``base``, and ``found``: base spans and those the models add, unless one lies in a base span."""
    marked = docs.withColumn("base", base_spans(F.col(text))).withColumn("added", markov_spans(F.col(text), ratios, threshold))
    more = F.filter("added", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return marked.withColumn("found", F.array_sort(F.concat("base", _kind(more, 3)))).drop("added")


def joined(found: Column) -> Column:
    """``kind:start:end`` in order, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])))


def redacted(text: Column, found: Column, mark: str = "<SECRET>") -> Column:
    """The text with every span, and spans that touch or overlap as one, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))).otherwise(
        F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
    )
    done = F.aggregate(found, start, step)
    return F.when(F.size(found) == 0, text).otherwise(F.concat(done["out"], F.substr(text, done["at"] + 1)))


def model_of(docs: DataFrame, text_column: str = "text", fit_rows: int = FIT_ROWS) -> list[float]:
    return train(staged(samples_from(pick(docs, text=text_column).withColumn("text", text_or_empty()), fit_rows), "samples"))


def secrets(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base`` and ``found`` (arrays of start, kind, end).

    ratios: a trained model (:func:`train`); by default one trained on what the base patterns
    mark in ``docs`` against ordinary words. Spans count code points, ends are exclusive,
    order is by start, then kind as in KINDS. A span of the models that lies in a base span is
    left out; one that goes beyond it stays as a whole beside it. Base spans always stay.

    Null and empty texts have no spans. Repeated rows get equal rows, null ids are kept, an
    empty table gives an empty result. Without training strings nothing is added to the base.
    """
    ratios = ratios if ratios is not None else model_of(docs, text_column)
    own = pick(docs, doc_id=id_column, text=text_column).withColumn("text", text_or_empty())
    return with_spans(own, "text", ratios, threshold).select("doc_id", "base", "found")


def without_secrets(docs: DataFrame, ratios: list[float] | None = None, mark: str = "<SECRET>", text_column: str = "text", size_column: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span replaced by a mark; ``size_column``, where there is one, follows.
    No row goes; a null text stays null; columns and their order stay."""
    ratios = ratios if ratios is not None else model_of(docs, text_column)
    flat, own = with_columns_of(docs, text=text_column)
    marked = with_spans(flat.withColumn("plain", text_or_empty()), "plain", ratios, threshold)
    clean = marked.withColumn("clean", F.when(F.size("found") == 0, F.col("text")).otherwise(redacted(F.col("plain"), F.col("found"), mark)))
    changed = {own[docs.columns.index(text_column)]: F.col("clean")}
    if size_column in docs.columns:
        at = docs.columns.index(size_column)
        size = F.when(F.size("found") == 0, F.col(own[at])).otherwise(F.length("clean").cast(docs.schema[at].dataType))
        changed[own[at]] = size
    return renamed_back(clean.withColumns(changed), own, docs.columns)
