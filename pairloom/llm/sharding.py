"""Sharding by balanced label propagation: linked documents move together, sizes stay even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import pick, staged, text_or_empty

#: Characters of the shortest passage that links texts, and what ends a passage: a line or a sentence.
SHORTEST, ENDS = 20, r"[.!?。！？\n]+\s*"
#: Passages that more texts share than one in so many of all links have their tallies broadcast.
HOT = 2000
#: Rounds of moves, and how far a shard may grow over its even share while they run.
ROUNDS, SLACK = 6, 1.02
#: A class of equal texts is cut where it is larger than this part of a shard.
PART_OF_SHARD = 4


def link_keys(text: Column) -> Column:
    """Hashes of all distinct passages of a text; two texts are linked once for each they share."""
    passages = F.filter(F.split(text, ENDS), lambda p: F.length(p) >= SHORTEST)
    return F.array_distinct(F.transform(passages, lambda p: F.xxhash64(p)))


def shared_links(members: DataFrame, of: str) -> DataFrame:
    """``members(<of>, hub)`` of hubs that two or more have, with ``hot``: whether so many have the
    hub that its tally is broadcast. There are no more than ``HOT`` such hubs; all others have so
    few members that they fit in a task."""
    linked = members.where("hub is not null").select(of, "hub")
    counts = staged(linked.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"), "hubs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    counts = counts.select("hub", (F.col("n") > max(100, total // HOT)).alias("hot"))
    hot = F.broadcast(counts.where("hot"))
    few = linked.join(hot.select("hub"), "hub", "left_anti").join(counts.where("not hot"), "hub")
    return linked.join(hot, "hub").unionByName(few)


def cut_edges(members: DataFrame, placed: DataFrame, of: str = "doc_id") -> DataFrame:
    """One row: ``links``, the pairs of ``members(<of>, hub)`` that share a hub, counted once for
    each, and ``cut``, those of them whose two ends are in different shards of ``placed(<of>, shard)``.
    Pairs are counted from the sizes of groups, never listed."""
    pairs = lambda n: n * (n - 1) / 2
    at = members.where("hub is not null").select(of, "hub").distinct().join(placed.select(of, "shard"), of)
    there = at.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    hubs = there.groupBy("hub").agg(F.sum("n").alias("all"), F.sum(pairs(F.col("n"))).alias("together"))
    links, together = F.coalesce(F.sum(pairs(F.col("all"))), F.lit(0)), F.coalesce(F.sum("together"), F.lit(0))
    return hubs.agg(links.cast("long").alias("links"), (links - together).cast("long").alias("cut"))


def _quotas(demand: list, load: list[float], capacity: float) -> dict[tuple[int, int], float]:
    """Share of the wish to move from i to j that is granted: what moves from j to i in
    exchange, and what j has free, dealt in proportion to the wishes for it."""
    wish = {(r["shard"], r["best"]): float(r["weight"]) for r in demand}
    beyond: dict[int, float] = {}
    for (i, j), w in wish.items():
        beyond[j] = beyond.get(j, 0.0) + max(0.0, w - wish.get((j, i), 0.0))
    out = {}
    for (i, j), w in wish.items():
        swap = min(w, wish.get((j, i), 0.0))
        free = max(0.0, capacity - load[j])
        extra = (w - swap) * min(1.0, free / beyond[j]) if beyond[j] else 0.0
        out[i, j] = (swap + extra) / w if w else 0.0
    return out


def propagate(members: DataFrame, shards: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``members(unit, hub, weight)``, one row per unit and hub (hub null: no link), to
    ``(unit, weight, shard)``.

    Units start at a hashed shard. In a round, every hub tallies the weight it has in each
    shard, a unit adds up the shares of its hubs, and wishes for the shard with the most if
    that is more than where it is. A hashed half of the units may move in a round, so that two
    that wish for each other do not trade places for ever, and a hashed share of them is
    granted, by quotas between each two shards. Tallies and wishes are partial aggregates of
    ``shards`` numbers; at most ``shards`` squared of them reach the driver. Tallies of hot
    hubs come to their members by broadcast.
    """
    base = staged(members.groupBy("unit").agg(F.first("weight").alias("weight")).withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int")), "start")
    linked = staged(shared_links(members, "unit"), "linked")
    total = base.agg(F.sum("weight")).first()[0]
    if not total or linked.isEmpty():
        return base
    names = [f"t{s}" for s in range(shards)]
    hot = F.broadcast(linked.where("hot").select("hub").distinct())
    for turn in range(rounds):
        placed = linked.join(base, "unit")
        tally = placed.groupBy("hub").agg(*(F.sum(F.when(F.col("shard") == s, F.col("weight")).otherwise(0)).alias(n) for s, n in enumerate(names)), F.sum("weight").alias("all"))
        share = lambda s, n: F.sum((F.col(n) - F.when(F.col("shard") == s, F.col("weight")).otherwise(0)) / F.col("all")).alias(n)
        with_tally = placed.where("not hot").join(tally, "hub").unionByName(placed.where("hot").join(F.broadcast(tally.join(hot, "hub", "left_semi")), "hub"))
        pull = with_tally.groupBy("unit", "weight", "shard").agg(*(share(s, n) for s, n in enumerate(names)))
        best = F.array_max(F.array(*(F.struct(F.col(n).alias("pull"), F.lit(-s).alias("s")) for s, n in enumerate(names))))
        own = F.element_at(F.array(*names), F.col("shard") + 1)
        active = F.pmod(F.xxhash64("unit", F.lit(1000 + turn)), F.lit(2)) == 0
        wishes = staged(pull.withColumn("top", best).where((F.col("top.pull") > own + 1e-9) & active).select("unit", "weight", "shard", (-F.col("top.s")).alias("best")), "wishes")
        demand = wishes.groupBy("shard", "best").agg(F.sum("weight").alias("weight")).collect()
        if sum(float(r["weight"]) for r in demand) < 0.0005 * float(total):
            break
        load = [0.0] * shards
        for r in base.groupBy("shard").agg(F.sum("weight").alias("weight")).collect():
            load[r["shard"]] = float(r["weight"])
        quota = _quotas(demand, load, slack * float(total) / shards)
        granted = F.element_at(F.create_map(*(F.lit(x) for (i, j), q in sorted(quota.items()) for x in (i * shards + j, q))), F.col("shard") * shards + F.col("best"))
        coin = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
        moves = wishes.where(coin < granted).select("unit", "best")
        base = staged(base.join(moves, "unit", "left").select("unit", "weight", F.coalesce("best", "shard").alias("shard")), "moved")
    return base


def ranked(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``rank`` (0, 1, ... in the order of the columns) and how many there are.

    Range partitions are sorted and staged with the place inside the partition; only one
    count per partition reaches the driver.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    dealt = staged(dealt.withColumn("part", F.shiftright(mark, 33).cast("int")).withColumn("place", mark.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    counts = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    begins = rows.sparkSession.createDataFrame(starts or [(0, 0)], "part int, begin long")
    return dealt.join(F.broadcast(begins), "part").withColumn("rank", F.col("begin") + F.col("place")).drop("part", "place", "begin"), at


def shards(docs: DataFrame, count: int = 16, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Texts are linked by every passage (line or sentence) they share; equal texts are one unit, cut in parts where they
    are over a quarter of a shard. Label propagation (:func:`propagate`) moves units to the
    shards of those they are linked with while row counts stay near even. Then the rows are
    ranked by shard, link and text, and the ranking is cut into ``count`` equal runs, so that
    counts differ by one at most (law ``rows``) and only the text at a cut is divided. slot
    counts the rows of a shard from 0. grown_shard is null under this law.

    size is the text's UTF-8 bytes plus 1. Null texts count as empty; empty texts are linked
    like equal texts. Repeated rows and null ids each get their own slot. An empty table
    gives an empty result. Only hashes and counts are shuffled, never a text.
    """
    own = pick(docs, doc_id=id_column, text=text_column).withColumn("text", text_or_empty())
    slim = own.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("k"), link_keys(F.col("text")).alias("links"), F.monotonically_increasing_id().alias("row"))
    rows = staged(slim, "rows")
    total = rows.count()
    most = max(1, total // (count * PART_OF_SHARD))
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), F.first("links").alias("links"))
    classes = staged(classes.withColumn("parts", F.ceil(F.col("n") / most).cast("int")), "texts")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    units = classes.select("k", part, (F.col("n") / F.col("parts")).alias("weight"), F.when(F.col("parts") > 1, F.concat("links", F.array("k"))).otherwise(F.col("links")).alias("links"))
    unit = F.xxhash64("k", "part").alias("unit")
    members = units.select(unit, "weight", F.explode_outer("links").alias("hub"))
    placed = propagate(members, count, rounds)
    # rows of a shard that share a passage lie side by side, so that a cut parts few of them
    near = shared_links(members, "unit").groupBy("unit").agg(F.min("hub").alias("near"))
    named = units.select(unit, "k", "part").join(placed.select("unit", "shard"), "unit").join(near, "unit", "left")
    chosen = named.withColumn("near", F.coalesce("near", "k"))
    # rows of a cut class are dealt to its parts by hash; the class side has one row per part
    with_part = rows.join(classes.select("k", "parts"), "k").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    laid = with_part.join(chosen.select("k", "part", "near", F.col("shard").alias("wanted")), ["k", "part"])
    order, n = ranked(laid.select("doc_id", "size", "text_crc32", "wanted", "near", "k", "row"), "wanted", "near", "k", "row")
    shard = F.expr(f"rank * {count} div {max(n, 1)}")
    start = F.expr(f"(shard * {max(n, 1)} + {count - 1}) div {count}")
    return order.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
