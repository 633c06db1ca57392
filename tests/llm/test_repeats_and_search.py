"""Periodic runs, substring dedup and ranked search against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from pairloom.llm import lexical, periodic, substrings
from pairloom.llm.queries import QUERIES

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty texts, repeated rows, a long text, and columns whose names clash."""
    data = [(None, "some words that stand here", 1), (1, None, 2), (2, "", 3), (3, " \t\n", 4)]
    data += [(4, "again and again " * 30, 5), (4, "again and again " * 30, 5), (5, "wörter\u00a0mit\x1cZeichen", 6)]
    data += [(6, " ".join(f"w{i % 997}" for i in range(150_000)), 7)]
    rows = spark.createDataFrame(data, "doc_id long, text string, v int")
    return rows.select("doc_id", "text", "v", *(F.lit(0).alias(c) for c in ("id", "RUNS", "n_words", "n", "Pack")))


# --- periodic runs


def plain_runs(words, least=6, times=4):
    found = []
    for q in range(1, len(words) // times + 1):
        s = 0
        while s < len(words) - q:
            e = s
            while e < len(words) - q and words[e] == words[e + q]:
                e += 1
            own = words[s : e + q]
            if e > s and len(own) >= max(least, times * q) and all(own[d:] != own[:-d] for d in range(1, q)):
                found.append((s, len(own), q))
            s = max(e, s + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(rng, n):
    """Random words of few kinds, with stretches that go round in a period."""
    words = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        at, p = rng.randrange(n), rng.randint(1, 12)
        for i in range(at, min(n, at + p * rng.randint(2, 9) + rng.randint(0, 3))):
            words[i] = words[at + (i - at) % p]
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 3), (20, 3), (1, 5)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    texts = [periodic_words(rng, rng.randint(1, 90)) for _ in range(400)]
    _, runs, left = periodic._read([" ".join(t).encode() for t in texts], least, times)
    for text, own, kept in zip(texts, runs, left):
        want = plain_runs(text, least, times)
        assert [(r["start"], r["length"], r["period"]) for r in own] == want
        assert kept.decode() == plain_collapsed(text, want)


def test_long_runs_and_nested_periods():
    unit = [f"u{i}" for i in range(700)]
    inner = ["x"] * 7 + ["y"]
    words = ["a", *unit * 5, *unit[:13], "b", *(inner * 4 + ["z"]) * 4]
    _, (runs,), _ = periodic._read([" ".join(words).encode()], 6, 4)
    got = [(r["start"], r["length"], r["period"]) for r in runs]
    assert (1, 3513, 700) in got and (3515, 132, 33) in got and (3515, 32, 8) in got and (3515, 7, 1) in got
    assert got == plain_runs(words)


def test_top_run_by_exact_ratio():
    big = 3**16
    # equal as fractions, then start, then period; ratios that differ by less than a float tells
    assert periodic.best_of([5, 2, 2], [8, 12, 16], [2, 3, 4]) == 1
    assert periodic.best_of([0, 1], [4 * big + 5, 4 * big + 1], [big + 1, big]) == 1
    assert Fraction(4 * big + 5, big + 1) < Fraction(4 * big + 1, big)


def plain_op11(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words) if n < 4000 else None
    if runs is None:
        return None
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapsed(words, runs)))


def test_op11_equals_brute_force_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(docs)
    for doc_id, text in docs.items():
        want = plain_op11(doc_id, text)
        assert want is None or got[doc_id] == want


def test_periodic_edge_cases(spark, odd):
    got = periodic.periodic_runs(odd)
    assert got.columns == [*odd.columns, "n_words_1", "runs_1", "top_run", "collapsed"]
    by_v = {}
    for r in rows_of(got):
        by_v.setdefault(r["v"], []).append(r)
    assert {v: len(x) for v, x in by_v.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 1}
    for v in (2, 3, 4):
        assert (by_v[v][0]["n_words_1"], by_v[v][0]["runs_1"], by_v[v][0]["top_run"], by_v[v][0]["collapsed"]) == (0, [], None, "")
    assert all(r["runs_1"] == [{"start": 0, "length": 90, "period": 3}] and r["collapsed"] == "again and again" for r in by_v[5])
    assert by_v[6][0]["collapsed"] == "wörter\u00a0mit\x1cZeichen" and by_v[6][0]["n_words_1"] == 1
    assert by_v[7][0]["top_run"] == {"start": 0, "length": 150_000, "period": 997}
    assert periodic.periodic_runs(odd.limit(0)).count() == 0


# --- substring dedup


def plain_kept(rows, window):
    """(words, removed word places) of every (id, text), windows in order of id and start."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out[doc_id] = words, gone
    return out


def passages(rng, docs, words=400):
    """Texts that share passages of many lengths, copies, and texts that repeat themselves."""
    vocabulary = [f"w{i}" for i in range(words)]
    shared = [rng.choices(vocabulary, k=k) for k in (3, 7, 19, 20, 21, 39, 40, 55, 130)]
    texts = []
    for _ in range(docs):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choices(vocabulary, k=rng.randint(0, 30)) + rng.choice(shared) * rng.choice((1, 1, 1, 2))
        texts.append(" ".join(text))
    return texts + rng.choices(texts, k=docs // 3)


@pytest.mark.parametrize(("window", "pack_bytes"), [(20, 600), (7, 5000), (1, 2000), (5, 1 << 20)])
def test_substrings_equal_brute_force(spark, monkeypatch, window, pack_bytes):
    monkeypatch.setattr(substrings, "HASHES_IN_GROUP", 300)
    rng = random.Random(window)
    texts = passages(rng, 90)
    ids = rng.sample(range(-500, 500), len(texts))
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {r["doc_id"]: r for r in rows_of(substrings.repeated_passages(docs, window, pack_bytes=pack_bytes))}
    want = plain_kept(rows, window)
    assert set(got) == set(want) and any(gone for _, gone in want.values())
    for doc_id, (words, gone) in want.items():
        own = got[doc_id]
        assert {i for s in own["removed"] for i in range(s["start"], s["end"])} == gone
        assert (own["n_words"], own["n_removed"]) == (len(words), len(gone))
        assert own["kept_text"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_lengths_double():
    assert substrings.lengths_of(20) == [5, 10, 20] and substrings.lengths_of(7) == [4, 7] and substrings.lengths_of(3) == [3]
    with pytest.raises(ValueError):
        substrings.lengths_of(0)


def test_hashes_survive_packing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (substrings._from_ascending(substrings._ascending(keys), len(keys)) == keys).all()
    ids = np.sort(rng.integers(-(2**62), 2**62, 100))
    assert (substrings._from_ascending(substrings._ascending(ids), 100).view(np.int64) == ids).all()


def test_packs_stay_where_they_are(spark):
    """Replies come to the packs; the packs themselves are never moved."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(list(enumerate(passages(random.Random(5), 30))), DOCS)
        found = substrings.repeated_passages(docs, 20, pack_bytes=500)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    packs = plan[plan.index("SortMergeJoin") :]
    left = packs[: packs.index("FileScan")]
    assert "Bucketed: true" in plan and "Exchange" not in left


def test_substring_edge_cases(spark, odd):
    found = substrings.repeated_passages(odd, 4)
    assert found.columns == [*odd.columns, "n_words_1", "n_removed", "removed", "kept_text"]
    rows = {r["v"]: r for r in rows_of(found)}
    assert found.count() == 8
    for v in (2, 3, 4):
        assert (rows[v]["n_words_1"], rows[v]["n_removed"], rows[v]["removed"], rows[v]["kept_text"]) == (0, 0, [], "")
    # rows that share id and text are one document: its windows repeat in itself alone
    twice = [r for r in rows_of(found) if r["v"] == 5]
    assert len(twice) == 2 and {(r["n_removed"], r["kept_text"]) for r in twice} == {(87, "again and again")}
    assert rows[7]["n_removed"] == 150_000 - 997 and len(rows[7]["kept_text"].split()) == 997
    # a null id stands before all others, rows that share an id are ordered by their texts
    text = "one two three four five six"
    few = spark.createDataFrame([(0, text), (None, text), (7, text + " a"), (7, text + " b")], DOCS)
    left = [(r["doc_id"], r["n_removed"]) for r in rows_of(substrings.repeated_passages(few, 4))]
    assert sorted(left, key=str) == [(0, 6), (7, 6), (7, 6), (None, 0)]
    assert sorted(r["n_removed"] for r in rows_of(substrings.repeated_passages(few.where("doc_id = 7"), 4))) == [0, 6]
    assert substrings.repeated_passages(odd.limit(0), 4).count() == 0


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranked(docs, items, top):
    counts = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    many = sum(1 for _, c in counts if c)
    total = sum(c.total() for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    w = {t: math.floor(1000 * math.log((2 * many + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            m = 100 - 75 + (75 * c.total() * many) // total if total else 0
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:top], 1):
            out.append((item_id, rank, doc_id, -score))
    return out


def random_documents(rng, n):
    words = [f"t{i}" for i in range(60)] + ["É", "z_z", "B", "ß"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice((1, 3, 10, 11, 12, 80)))) for _ in range(n)]
    return texts + rng.choices(texts, k=n // 3) + ["", None, "-- !"]


@pytest.mark.parametrize(("top", "item_bytes"), [(10, 1 << 20), (3, 40), (1000, 300)])
def test_ranking_equals_brute_force(spark, monkeypatch, top, item_bytes):
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical, "POSTINGS_AT_ONCE", 400)
    rng = random.Random(top)
    docs = list(zip(rng.sample(range(10_000), 403), random_documents(rng, 300)))
    items = [(i, " ".join(rng.choices([f"T{i}" for i in range(60)], k=rng.randint(1, 12)))) for i in range(25)]
    items += [(90, "nothing known"), (91, ""), (92, None), (93, "É b t0"), (94, items[0][1])]
    found = lexical.ranked(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(items, "item_id int, text string"), top)
    assert sorted(map(tuple, found.collect())) == sorted(plain_ranked(docs, items, top))


def test_ranking_with_equal_scores_and_hot_lengths(spark):
    """All documents of one length, most of them equal: ties go by id, over many blocks."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "a b c d").otherwise("a x c y").alias("text"))
    items = spark.createDataFrame([(1, "b"), (2, "x a"), (3, "a")], "item_id int, text string")
    found = lexical.ranked(docs, items)
    got = {i: [r["doc_id"] for r in sorted(found.where(F.col("item_id") == i).collect())] for i in (1, 2, 3)}
    assert got == {1: [1, 2, 3, 5, 6, 7, 9, 10, 11, 13], 2: list(range(0, 40, 4)), 3: []}


def test_ranking_edge_cases(spark, odd):
    items = spark.createDataFrame([(1, "again", 0), (1, "again", 0), (None, "words w3", 0)], "item_id int, text string, Score int")
    rows = sorted(map(str, rows_of(lexical.ranked(odd, items, 10))))
    assert len(rows) == 6 and sum("'doc_id': 4" in r for r in rows) == 4 and sum("'item_id': None" in r for r in rows) == 2
    assert lexical.ranked(odd.limit(0), items).count() == 0 and lexical.ranked(odd, items.limit(0)).count() == 0
    assert lexical.ranked(odd.limit(0), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_queries_equal_sql(spark):
    import duckdb

    from check_oracles import TABLES
    from pairloom.llm.queries import ORACLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert set(ORACLES) == {"op12_substring_dedup", "op13_ranked_search"}
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        cursor = con.execute(sql)
        assert df.columns == [d[0] for d in cursor.description]
        assert Counter(map(tuple, df.collect())) == Counter(cursor.fetchall())
