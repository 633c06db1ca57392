"""Exact token counts of every prefix, built once per text by dynamic programming over words."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import kept_in_worker, pick, text_or_empty

#: Words remembered by a worker, and texts whose words are looked up together.
REMEMBERED, TEXTS_AT_ONCE = 600_000, 1024
#: Words that are new to a worker are handed to the library in parts of this many.
WORDS_AT_ONCE = 20_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Prefixes:
    """Token counts of prefixes for a tokenizer that keeps no token across white space.

    Count of a prefix = count up to the last word before it + count of the begun word. The
    counts of whole words are remembered by word; those inside a word are found when asked for.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, int] = {}

    def _counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def of_words(self, words: set[bytes]) -> dict[bytes, int]:
        """Counts of words. The first ``REMEMBERED`` that are met, among which are the frequent
        ones, are kept; the others are counted again when they come again."""
        known = {w: self.words[w] for w in words if w in self.words}
        new = list(words.difference(known))
        fresh: dict[bytes, int] = {}
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            fresh.update(zip(part, self._counts([w.decode("utf-8", "surrogatepass") for w in part])))
        self.words.update(islice(fresh.items(), max(0, REMEMBERED - len(self.words))))
        return known | fresh

    def at_words(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text: the exact count of the text up to the end of word 1, 2, ..."""
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            split = [t.encode("utf-8", "surrogatepass").split() for t in texts[at : at + TEXTS_AT_ONCE]]
            known = self.of_words(set().union(*split))
            for words in split:
                yield np.cumsum(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))

    def at_characters(self, text: str) -> np.ndarray:
        """For each character: the exact count of the text up to and with it."""
        out = np.zeros(len(text), np.int64)
        at, done = 0, 0
        for start, end in _spans(text):
            out[at:start] = done
            inside = self._counts([text[start : i + 1] for i in range(start, end)])
            out[start:end] = np.array(inside) + done
            done, at = done + inside[-1], end
        out[at:] = done
        return out


#: White space that ends a word for this purpose: the ASCII part of what the library drops.
SPACE = " \t\n\r\x0b\x0c"


def _spans(text: str) -> Iterator[tuple[int, int]]:
    start = None
    for i, c in enumerate(text):
        if c in SPACE:
            if start is not None:
                yield start, i
                start = None
        elif start is None:
            start = i
    if start is not None:
        yield start, len(text)


def prefix_counts(text: Column, path: str, every: str = "word") -> Column:
    """Column of ``array<int>``: the exact token count of each prefix of a text.

    every="word": of the prefixes that end with word 1, 2, ... (words: runs without ASCII white
    space). every="character": of the prefixes with 1, 2, ... characters.
    """

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = kept_in_worker(f"prefixes {path}", lambda: Prefixes(path))
        for texts in batches:
            if every == "character":
                yield pd.Series([own.at_characters(t).astype(np.int32) for t in texts], dtype=object)
                continue
            yield pd.Series([c.astype(np.int32) for c in own.at_words(texts.tolist())], dtype=object)

    return of(text)


def within_budget(counts: Column, budget: int) -> Column:
    """Number of words (or characters) of the longest prefix with ``budget`` tokens at most,
    from stored counts. Counts of words never fall, so they can be counted off."""
    return F.size(F.filter(counts, lambda c: c <= budget))


def count_at(counts: Column, length: Column | int) -> Column:
    """Tokens of the prefix of ``length`` words (or characters); all of it beyond the end."""
    upto = F.least(F.lit(length) if isinstance(length, int) else length, F.size(counts))
    return F.when(upto <= 0, 0).otherwise(F.element_at(counts, F.greatest(upto, F.lit(1)).cast("int")))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit, prefix_tokens``.

    prefix_tokens holds the exact count up to the end of each word, so later questions about
    truncation and budgets (:func:`within_budget`, :func:`count_at`) need no tokenizer. The
    last one is n_tokens: what the library returns for the whole text, without added tokens,
    truncation or padding, and with special strings in texts handled as it does.

    Null and empty texts, and texts of white space, have no tokens and an empty array.
    Repeated rows get equal rows, null ids are kept, an empty table gives an empty result.
    Texts that are not valid Unicode are replaced as Spark reads them.
    """
    own = pick(docs, doc_id=id_column, text=text_column).withColumn("text", text_or_empty())
    counted = own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), prefix_counts(F.col("text"), path).alias("prefix_tokens"))
    total = F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0)).cast("long")
    return counted.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"), "prefix_tokens")
