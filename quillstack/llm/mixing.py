"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of the document id. A source's blocks stand in a random order that a seed
fixes; whole passes and the first blocks of a further pass make up the source's target, the last of them cut at the
first document that does not fit. What is then missing comes from all documents left out, size class by size class from
the largest, and at last from single ones, until none that is left fits. The draws of all sources (pass, block) are exact quotas; a binary tree halves the set of
output shards again and again and deals every node's quotas to its two halves by a multivariate hypergeometric draw,
so every shard gets its number of draws and every draw goes to one shard. Within a shard, rows are ordered by a hash.

A null text has size 0; null sources are a source of their own, in last place; a null id is an id like any other (such
documents share a block). Repeated rows are separate documents. An empty table gives an empty mix. The driver holds one
number per source and shard, one per source and size class and a few documents of each, never rows or blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.windows import running_sum
from quillstack.llm.common import word_count, written

#: Blocks of a source and output shards.
BLOCKS, SHARDS = 1024, 16
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
MOST_PASSES = 3
#: Single documents offered to complete a source, for each power of two of words: so many of the smallest, so many in order.
#: A gap of more than so many documents of a class is filled by the class's running sum.
SPARE = 8


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_PASSES) -> dict[str | None, float]:
    """Targets by source: weights in code point order, null last; what goes over ``most`` times a size is shared anew."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    return target


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) numbers of draws: rows differ by one in their sums at most, columns sum to ``quotas``."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def deal(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle, total = (low + high) // 2, int(counts.sum())
        take = total * (middle - low) // (high - low)
        name = hashlib.sha256(f"{seed}/{low}/{high}".encode()).digest()
        rng = np.random.default_rng(int.from_bytes(name[:8], "big"))
        left = np.zeros_like(counts)
        rest_all, rest = total, take
        for i, n in enumerate(counts.tolist()):  # one hypergeometric draw for each source, given those before
            rest_all -= n
            left[i] = rest if rest_all == 0 else rng.hypergeometric(n, rest_all, rest) if n and rest else 0
            rest -= left[i]
        deal(left, low, middle)
        deal(counts - left, middle, high)

    if quotas:
        deal(np.array(quotas, np.int64), 0, shards)
    return out


def class_shares(gap: float, sums: dict[int, int]) -> tuple[list[int], int | None, float]:
    """Size classes (powers of two) to take whole, the class to take up to the gap then left, if any, and that gap."""
    whole = []
    for power in sorted(sums, reverse=True):
        if sums[power] <= gap:
            whole.append(power)
            gap -= sums[power]
        elif gap >= SPARE * 2**power:
            return whole, power, gap
    return whole, None, gap


def completing(gap: float, offers: list[tuple]) -> list[tuple]:
    """Of ``offers`` (words first), the largest that fit ``gap`` one after the other, then one too large if that is nearer."""
    chosen, offers = [], sorted(offers, key=lambda x: (-x[0], x[1]))
    for offer in offers:
        if offer[0] <= gap:
            chosen.append(offer)
            gap -= offer[0]
    larger = [x for x in offers if gap < x[0] < 2 * gap and x not in chosen]
    return chosen + larger[-1:]


def filled(chosen: DataFrame, key: list[str]) -> tuple[DataFrame, set]:
    """``chosen`` with more rows taken until no source misses SPARE documents of a size class it has left, and the sources changed."""
    spark, changed = chosen.sparkSession, set()
    left = (F.col("taken") == 0) & (F.col("words") > 0)
    while True:
        gaps = {(r[0], r[1]): r[2] for r in chosen.groupBy(*key).agg(F.first("more") - F.sum(F.col("words") * F.col("taken"))).collect()}
        sums: dict[tuple, dict[int, int]] = {}
        for r in chosen.filter(left).groupBy(*key, "power").agg(F.sum("words")).collect():
            sums.setdefault((r[0], r[1]), {})[r[2]] = r[3]
        rows = []
        for s, by_power in sums.items():
            whole, part, gap = class_shares(gaps[s], by_power)
            rows += [(*s, p, float("inf")) for p in whole] + ([(*s, part, float(gap))] if part is not None else [])
        if not rows:
            return chosen, changed
        changed |= {r[:2] for r in rows}
        room = spark.createDataFrame(rows, "none boolean, name string, power long, room double")
        met = chosen.join(F.broadcast(room), [*key, "power"], "left")
        # A class may hold most rows: the sum runs by ranges of the random order.
        asked = met.filter(left & F.col("room").isNotNull()).withColumn("range", F.shiftright("order", 54))
        asked = running_sum(asked, [*key, "power"], [F.col(c) for c in ("order", "doc_id", "size")], "range", F.col("words"), "so_far")
        asked = asked.withColumn("taken", (F.col("so_far") <= F.col("room")).cast("int"))
        rest = met.filter(~left | F.col("room").isNull())
        chosen = written(rest.select(*chosen.columns).unionByName(asked.select(*chosen.columns)), "mix-filled")


def plan(
    docs: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS,
    blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 9,
) -> DataFrame:
    """One row per distinct (id, source, size): doc_id, source, size, n (rows alike), source_size, target, copies, shard_of.

    ``copies`` counts how often the mix takes each of the rows alike, ``shard_of`` lists the shard of every copy.
    """
    spark = docs.sparkSession
    units = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")
    ).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    units = written(
        units.select(
            "*", (F.col("n") * F.col("size")).alias("words"), F.col("source").isNull().alias("none"),
            F.coalesce("source", F.lit("")).alias("name"),
            F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(blocks)).alias("block"),
            F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string"), "size").alias("order"),
        ),
        "mix-units",
    )
    key = ["none", "name"]
    by_block = units.groupBy(*key, "block").agg(F.sum("words").alias("block_words"))
    sizes = {None if r[0] else r[1]: r[2] for r in units.groupBy(*key).agg(F.sum("words")).collect()}
    target = source_targets(sizes, weights)
    passes = {s: min(int(target[s] // n), MOST_PASSES) if n else 0 for s, n in sizes.items()}
    table = spark.createDataFrame(
        [(s is None, s or "", n, target[s], passes[s], target[s] - passes[s] * n) for s, n in sizes.items()],
        "none boolean, name string, source_size long, target double, passes int, more double",
    )
    # A source has `blocks` rows here at most: the random order of its blocks, and the words before each. `more` words
    # are wanted beyond the whole passes: whole blocks as long as they fit, and a part of the block that does not.
    before = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed + 2), "block"), "block")
    start = F.sum("block_words").over(before) - F.col("block_words")
    ranked = by_block.join(F.broadcast(table), key).select(
        *key, "block", "source_size", "target", "passes", "more", start.alias("start"),
        (F.row_number().over(before) - 1).alias("at"),
        F.when(start + F.col("block_words") <= F.col("more"), "whole").when(start < F.col("more"), "cut").otherwise("out").alias("part"),
    )
    joined = units.join(ranked, [*key, "block"])
    within = Window.partitionBy(*key, "block").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = joined.filter("part = 'cut'").withColumn("taken", (F.col("start") + F.sum("words").over(within) <= F.col("more")).cast("int"))
    rest = joined.filter("part <> 'cut'").withColumn("taken", (F.col("part") == "whole").cast("int"))
    chosen = rest.unionByName(cut).withColumn("power", F.when(F.col("words") > 0, F.floor(F.log2("words"))).otherwise(0))
    chosen, changed = filled(written(chosen, "mix-chosen"), key)
    # Single documents complete a source. Fewer than SPARE of a class fit: if any does, one of the smallest does.
    left_out = chosen.filter("taken = 0 AND words > 0")
    first = Window.partitionBy(*key, "power").orderBy("order", "doc_id", "size")
    least = Window.partitionBy(*key, "power").orderBy("words", "order", "doc_id", "size")
    spare = [left_out.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= SPARE) for w in (first, least)]
    spare = spare[0].unionByName(spare[1]).drop("nth").distinct()
    offers: dict[tuple, list] = {}
    for r in spare.select(*key, "words", "order", "doc_id", "size").collect():
        offers.setdefault((r[0], r[1]), []).append((r["words"], r["order"], r["doc_id"], r["size"]))
    state = chosen.groupBy(*key).agg(
        F.first("passes").alias("passes"), (F.first("more") - F.sum(F.col("words") * F.col("taken"))).alias("gap")
    ).join(ranked.groupBy(*key).agg(F.count("*").alias("all"), F.sum((F.col("part") != "out").cast("long")).alias("some")), key)
    # Rows taken beyond the first blocks go with their blocks' draws.
    state = sorted((r.asDict() for r in state.collect()), key=lambda r: (r["none"], r["name"]))
    for r in state:
        r["some"] = r["all"] if (r["none"], r["name"]) in changed else r["some"]
    fills = {(r["none"], r["name"]): completing(r["gap"], offers.get((r["none"], r["name"]), [])) for r in state}
    # Draws of a source: its blocks once for each whole pass, the blocks of the last pass, the completing documents.
    quotas = split_quotas([r["passes"] * r["all"] + r["some"] + len(fills[r["none"], r["name"]]) for r in state], shards, seed)
    kind = units.schema["doc_id"].dataType.simpleString()
    ends = spark.createDataFrame(
        [(r["none"], r["name"], np.cumsum(quotas[:, i]).tolist(), r["all"]) for i, r in enumerate(state)],
        "none boolean, name string, ends array<long>, all long",
    )
    extra = spark.createDataFrame(
        [
            (r["none"], r["name"], x[2], x[3], r["passes"] * r["all"] + r["some"] + i)
            for r in state for i, x in enumerate(fills[r["none"], r["name"]])
        ],
        f"none boolean, name string, fill_id {kind}, fill_size long, fill_draw long",
    )
    same = (
        (F.col("c.none") == F.col("f.none")) & (F.col("c.name") == F.col("f.name"))
        & F.col("doc_id").eqNullSafe(F.col("fill_id")) & (F.col("size") == F.col("fill_size"))
    )
    placed = chosen.join(F.broadcast(ends), key).alias("c").join(F.broadcast(extra).alias("f"), same, "left").select("c.*", "fill_draw")
    # The draw number of a copy, in the random order of blocks, gives its shard.
    none = F.expr("cast(array() as array<long>)")
    draws = F.concat(
        F.when(F.col("passes") + F.col("taken") > 0, F.expr("transform(sequence(1, greatest(passes + taken, 1)), c -> (c - 1) * all + at)")).otherwise(none),
        F.when(F.col("fill_draw").isNotNull(), F.array("fill_draw")).otherwise(none),
    )
    shard = F.transform(draws, lambda d: F.size(F.filter("ends", lambda e: e <= d)))
    return placed.select("doc_id", "source", "size", "n", "source_size", "target", shard.alias("shard_of")).withColumn("copies", F.size("shard_of"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 9, **options) -> DataFrame:
    """The mix: a row of ``docs`` for each copy taken, with ``shard`` and ``place``, the key of the local shuffle.

    Columns of ``docs`` named shard or place are replaced.
    """
    own = [c for c in docs.columns if c not in ("shard", "place")]
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    planned = plan(written(sizes, "mix-sizes"), seed=seed, **options).filter("copies > 0")
    p = planned.select(*[F.col(c).alias(f"mix_{c}") for c in ("doc_id", "source", "size", "shard_of")])
    same = (
        F.col("d.row")[id_col].eqNullSafe(F.col("mix_doc_id")) & F.col("d.row")[source].eqNullSafe(F.col("mix_source"))
        & (F.col("d.words") == F.col("mix_size"))
    )
    rows = docs.select(F.struct(*own).alias("row"), word_count(F.col(text)).alias("words")).alias("d")
    return rows.join(p, same).select("row", F.posexplode("mix_shard_of").alias("copy", "shard")).select(
        "row.*", "shard", F.xxhash64(F.lit(seed + 3), "shard", "copy", F.col("row")[id_col].cast("string")).alias("place")
    )
