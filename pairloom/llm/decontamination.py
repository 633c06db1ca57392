"""Benchmark decontamination: canonical templates, hash-joined windows and slot consistency.

Everything is a column expression or a join of DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.arrays import bound
from pairloom.llm.common import pick, renamed_back, staged, text_or_empty, with_columns_of

# Units of measure that follow a number.
UNITS = (
    "mm cm km m mg kg g lb lbs oz ml cl l ms s sec min h hr hrs day days week weeks month months year years "
    "hour hours minute minutes second seconds inch inches foot feet yard yards mile miles meter meters metre "
    "metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres pound pounds ounce "
    "ounces dollar dollars euro euros cent cents percent degree degrees mph kmh"
).split()
#: A unit directly or one space after a number.
UNIT = r"(?<=\p{N} ?)(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
#: A capitalised word that does not begin a sentence.
NAME = r"(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)(?!\p{L})"
#: Marked units and names, numbers, words.
TOKEN = r"[%@]\p{L}[\p{L}\p{M}']*|\p{N}+(?:[.,:/]\p{N}+)*|\p{L}[\p{L}\p{M}']*"
#: Template tokens of a window (fewer for an item that has fewer); share of an item's tokens
#: that must be matched.
WINDOW, COVERAGE = 5, 0.7
#: Windows of a benchmark that are broadcast at most (about 40 bytes each).
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Words, numbers, and units and names with a mark in front (``%kg``, ``@Ann``)."""
    marked = F.regexp_replace(F.regexp_replace(text, UNIT, "%$1"), NAME, "@$1")
    return F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))


def template(found: Column) -> Column:
    """Tokens with numbers, names and units replaced by ``#``, ``@`` and ``%``, words in lower case."""
    first = lambda t: F.left(t, F.lit(1))
    return F.transform(found, lambda t: F.when(first(t).isin("%", "@"), first(t)).when(first(t).rlike(r"\p{N}"), "#").otherwise(F.lower(t)))


def windows_at(words: Column, window: int) -> Column:
    """``at`` and ``h``, a hash of place and words, of the ``window`` words from every token on.
    Each word is hashed once."""
    none = F.array().cast("array<int>")

    def windows(h: Column) -> Column:
        starts = F.when(F.size(h) >= window, F.sequence(F.lit(0), F.size(h) - window)).otherwise(none)
        own = lambda at: F.xxhash64(F.lit(window), *(F.get(h, at + i) for i in range(window)))
        return F.transform(starts, lambda at: F.struct(at.alias("at"), own(at).alias("h")))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def items_of(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Items with raw tokens and template; equal ids are told apart by text."""
    own = pick(benchmark, item_id=item_column, text=text_column).where("text is not null").distinct()
    raw = own.withColumn("item_raw", tokens(F.col("text")))
    return raw.select("item_id", _text_key(F.col("text")).alias("item"), "item_raw", template(F.col("item_raw")).alias("item_words"))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """Windows of every item, ``size`` tokens each: ``window``, or all of an item that has no more.

    Those with two plain words or more; where an item has none, all of its windows.
    """
    parts: list[DataFrame] = []
    for size in range(1, window + 1):
        long = F.size("item_words") >= size if size == window else F.size("item_words") == size
        own = items.where(long).select("item", "item_words", F.inline(windows_at(F.col("item_words"), size)))
        plain = F.size(F.filter(F.slice("item_words", F.col("at") + 1, size), lambda w: ~w.isin("#", "@", "%")))
        parts.append(own.select(F.lit(size).alias("size"), "h", "item", F.col("at").alias("item_at"), (plain >= 2).alias("telling")))
    windows = parts[0]
    for more in parts[1:]:
        windows = windows.union(more)
    some = windows.groupBy("item").agg(F.max("telling").alias("some"))
    return windows.join(some, "item").where(F.col("telling") | ~F.col("some")).select("size", "h", "item", "item_at").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Matched pairs of ``docs(text)`` and ``benchmark(item_id, text)``: one row per distinct
    text and item, ``key, item_id, covered, changed_slots``. See :func:`contamination`."""
    items = staged(items_of(benchmark), "items")
    sought = staged(windows_of(items, window), "windows")
    sizes = sorted((r["size"], r["count"]) for r in sought.groupBy("size").count().collect())  # no more than `window`
    small = sum(n for _, n in sizes) <= BROADCAST_ROWS
    sought = sought.drop("size")
    if small:
        sought = F.broadcast(sought)
    words = docs.select(_text_key(F.col("text")).alias("key"), template(tokens(F.col("text"))).alias("words"))
    none = F.array().cast("array<struct<at:int,h:bigint>>")
    seen = words.select("key", F.inline(bound(F.col("words"), lambda w: F.concat(none, *(windows_at(w, size) for size, _ in sizes)))))
    seeds = staged(seen.join(sought, "h").select("key", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "seeds")

    hit = docs.select(_text_key(F.col("text")).alias("key"), "text").join(seeds.select("key").distinct(), "key")
    texts = hit.groupBy("key").agg(F.first("text").alias("text"))
    raw = staged(texts.select("key", tokens(F.col("text")).alias("raw")).withColumn("words", template(F.col("raw"))), "texts")
    laid = seeds.join(raw, "key").join(items, "item")
    place = lambda p: p + F.col("shift")
    inside = F.filter(F.sequence(F.lit(0), F.size("item_words") - 1), lambda p: (place(p) >= 0) & (place(p) < F.size("words")) & (F.get("words", place(p)) == F.get("item_words", p)))
    laid = laid.withColumn("equal", inside)
    slots = F.filter("equal", lambda p: F.get("item_words", p).isin("#", "@", "%"))
    pair = lambda p: F.struct(F.get("item_raw", p).alias("old"), F.get("raw", place(p)).alias("new"), F.get("item_words", p).alias("type"))
    laid = laid.withColumn("slots", F.array_distinct(F.transform(slots, pair)))
    count = lambda field: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["type"].alias("t"), s[field].alias("v")))))
    # one to one: an old value always became the same new one, and no two the same
    laid = laid.withColumn("consistent", (count("old") == F.size("slots")) & (count("new") == F.size("slots")))
    kept = F.when(F.col("consistent"), F.col("equal")).otherwise(F.filter("equal", lambda p: ~F.get("item_words", p).isin("#", "@", "%")))
    changed = F.size(F.filter("slots", lambda s: s["old"] != s["new"]))
    one = laid.select("key", "item", "item_id", F.size("item_words").alias("n"), F.explode(kept).alias("place"), F.when(F.col("consistent"), changed).otherwise(0).alias("changed"))
    covered = one.groupBy("key", "item", "item_id").agg((F.count_distinct("place") / F.first("n")).alias("covered"), F.max("changed").alias("changed_slots"))
    return covered.where(F.col("covered") >= coverage).select("key", "item_id", "covered", "changed_slots")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, contaminated, n_items, item_ids, covered, changed_slots``.

    Numbers, capitalised words inside a sentence, and units after a number become typed
    placeholders; the rest goes to lower-case words. Documents and items have a window of
    ``window`` tokens at every token, so any shared run of that length shares a hash; an item
    that is shorter is a window by itself. Windows of an item with fewer than two plain words do
    not seek documents, unless the item has no others. Each hit lays the item over the document; tokens that
    are equal there count, placeholders only where the values map one to one, so a question
    with other numbers or names is caught and a chance pattern of placeholders is not. A
    document is contaminated by an item if ``coverage`` of the item's tokens are matched, over
    all places where it is laid. changed_slots is the most values that a match has changed.

    Null and empty texts are clean. Items that are null or have no token match nothing.
    Repeated rows of either table change nothing; null ids are kept (null item ids count as an
    item, and are not listed). Empty tables: no documents, an empty result; no items, all clean.
    """
    own = pick(docs, doc_id=id_column, text=text_column).withColumn("text", text_or_empty())
    found = matches(own, pick(benchmark, item_id=item_column, text=text_column), window, coverage)
    each = staged(found.groupBy("key").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"), F.max("changed_slots").alias("changed_slots")), "contaminated")
    joined = own.select("doc_id", _text_key(F.col("text")).alias("key")).join(each, "key", "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), zero("n_items", 0), F.coalesce("item_ids", F.array().cast(each.schema["item_ids"].dataType)).alias("item_ids"), zero("covered", 0.0), zero("changed_slots", 0))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`contamination` marks; columns and order of columns stay."""
    flat, own = with_columns_of(docs, text=text_column)
    keyed = flat.withColumn("text", text_or_empty())
    found = staged(matches(keyed.select("text"), pick(benchmark, item_id="item_id", text="text"), window, coverage).select("key").distinct(), "leaks")
    return renamed_back(keyed.withColumn("key", _text_key(F.col("text"))).join(found, "key", "left_anti"), own, docs.columns)
