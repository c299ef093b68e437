"""Mixing sources to target weights by Sainte-Lague apportionment of equal-size blocks.

DataFrame functions only. Sizes are words. A source's documents are dealt into shards of
about ``shard_words`` and put in a seeded order; the shard's words in that order are cut into
blocks. Blocks are apportioned to sources by highest quotients (target / 1, 3, 5, ...), a
source's blocks to its shards likewise, and a shard with quota q of b blocks takes every
block ``q div b`` times and a run of ``q mod b`` blocks, from a seeded place on, once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, keyed_rows, words, written

WEIGHTS, BUDGET_PERCENT, MAX_COPIES = (3, 1, 2), 150, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 32, 1 << 20, "mix"


def _hash32(*parts: Column) -> Column:
    """32 seeded bits of some values (the first eight hex digits of their MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """``totals(sk, source_size)`` with ``target``: the budget shared by weight, no source
    above ``max_copies`` times its size, the excess reshared among the others.

    That is the level L with ``sum(least(max_copies * size, L * weight)) = budget``, found by
    running sums over the sources in the order in which they fill up. One row per source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (totals.withColumn("rank", F.row_number().over(Window.orderBy("sk")) - 1)
              .withColumn("w", w).withColumn("cap", max_copies * F.col("source_size")))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (ranked.withColumn("all_words", F.sum("source_size").over(everything))
             .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
             .withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
             .withColumn("left", F.col("all_words") * budget_percent / 100 - F.col("full")))
    # sources fill up in this order until one stays below its cap: from there on the level holds
    level = (level.withColumn("open", F.col("w") * F.col("left") / F.col("rest_w") < F.col("cap"))
             .withColumn("first_open", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "sk", "left", "rest_w")))
                         .over(everything)))
    after = F.struct(F.col("cap") / F.col("w"), F.col("sk")) >= F.struct(F.col("first_open.col1"), F.col("first_open.sk"))
    return level.select("sk", "source_size", F.when(
        F.col("first_open").isNotNull() & after, F.col("w") * F.col("first_open.left") / F.col("first_open.rest_w"))
        .otherwise(F.col("cap").cast("double")).alias("target"))


def apportion(parties: DataFrame, group: list, party: list, claim: str, seats: str, quota: str = "quota") -> DataFrame:
    """``parties`` with ``quota``: ``seats`` of each group (a column, equal in the group) given
    one by one to the highest quotient ``claim / (2 k + 1)``; equal quotients by party order.

    With n parties and claims summing to T, divisors T / (seats -+ n/2) give each party
    proven least and most seats that differ by about 2 n in all; only the seats between them
    are ranked. Parties without a claim get nothing.
    """
    whole = Window.partitionBy(*group)
    sized = (parties.withColumn("_n", F.sum(F.when(F.col(claim) > 0, 1).otherwise(0)).over(whole))
             .withColumn("_t", F.sum(claim).over(whole))
             .withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col(claim) * (F.col(seats) - F.col("_n") / 2 - 1) / F.col("_t") + 0.5)))
             .withColumn("_hi", F.floor(F.col(claim) * (F.col(seats) + F.col("_n") / 2 + 1) / F.col("_t") + 0.5))
             .withColumn("_lo", F.when(F.col(claim) > 0, F.least("_lo", seats)).otherwise(0).cast("long"))
             .withColumn("_hi", F.when(F.col(claim) > 0, F.greatest("_hi", "_lo")).otherwise(0).cast("long"))
             .withColumn("_free", F.col(seats) - F.sum("_lo").over(whole)))
    open_seats = sized.where("_hi > _lo").withColumn("_seat", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(claim) / (2 * F.col("_seat") - 1)), *party)
    won = (open_seats.withColumn("_rank", F.row_number().over(best)).where("_rank <= _free")
           .groupBy(*group, *party).agg(F.count(F.lit(1)).alias("_won")))
    return (sized.join(won, [*group, *party], "left")
            .withColumn(quota, F.col("_lo") + F.coalesce("_won", F.lit(0)))
            .drop("_n", "_t", "_lo", "_hi", "_free", "_won"))


def _key(source: Column) -> Column:
    """A sort key without nulls: sources in code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_copies: int = MAX_COPIES,
             block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED, key_col: str | None = None) -> DataFrame:
    """Per row of ``docs``: ``id, source, size, source_size, target, taken, copies, from_1, to_1, from_2, to_2``
    and ``key`` (its ``key_col``, or null), by which rows without an id are dealt to shards.

    ``copies`` whole copies are taken, and the word ranges ``[from, to)`` once more (up to two
    where the shard's run wraps around; empty if ``from >= to``): ``taken`` words in all.
    Blank, empty and null texts have size 0 and take nothing; a null source is a source of
    its own, after the others; rows with equal ids keep their order by size and stay separate;
    an empty table gives an empty plan. Reruns agree: all choices hang on ids and the seed.
    """
    slim = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _key(F.col(source_col)).alias("sk"),
                               F.size(words(F.col(text_col))).cast("long").alias("size"),
                               (F.col(key_col) if key_col else F.lit(None)).cast("string").alias("key")), "mix")
    totals = slim.groupBy("sk").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, budget_percent, max_copies)
    seats = targets.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")) \
        .withColumn("_all", F.lit(0))
    sources = written(apportion(seats, ["_all"], ["sk"], "target", "_seats", "blocks")
                      .select("sk", "source_size", "target", "blocks",
                              F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards")), "mix")
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.col("key")), F.lit(""))
    dealt = (slim.join(sources.select("sk", "shards"), "sk")
             .withColumn("shard", F.pmod(_hash32(F.lit(seed), F.lit("shard"), key), F.col("shards"))).drop("shards"))
    cells = dealt.groupBy("sk", "shard").agg(F.sum("size").alias("cell_size"))
    cells = apportion(cells.join(sources, "sk"), ["sk"], ["shard"], "cell_size", "blocks", "quota")
    n = F.ceil(F.col("cell_size") / block).cast("long")
    q = F.least(F.col("quota"), max_copies * n)
    cells = (cells.withColumn("n", n).withColumn("copies", F.when(n > 0, F.floor(q / n)).otherwise(0).cast("long"))
             .withColumn("more", F.when(n > 0, F.pmod(q, n)).otherwise(0))
             .withColumn("at", F.when(n > 0, F.pmod(_hash32(F.lit(seed), F.lit("run"), F.col("sk"), F.col("shard").cast("string")), n)).otherwise(0)))
    # the run of blocks [at, at + more), wrapped around, as word ranges of the shard
    cells = cells.select("sk", "shard", "source_size", "target", "copies",
                         (F.col("at") * block).alias("a1"), F.least((F.col("at") + F.col("more")) * block, "cell_size").alias("b1"),
                         F.lit(0).cast("long").alias("a2"),
                         F.greatest(F.lit(0), (F.col("at") + F.col("more") - F.col("n")) * block).cast("long").alias("b2"))
    order = (Window.partitionBy("sk", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), "id", "size", "key")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (dealt.withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
              .join(cells, ["sk", "shard"]))
    for i in ("1", "2"):
        placed = (placed.withColumn(f"from_{i}", F.greatest(F.col("start"), F.col(f"a{i}")) - F.col("start"))
                  .withColumn(f"to_{i}", F.least(F.col("end"), F.col(f"b{i}")) - F.col("start")))
    taken = F.col("copies") * F.col("size")
    for i in ("1", "2"):
        taken = taken + F.greatest(F.lit(0), F.col(f"to_{i}") - F.col(f"from_{i}"))
    return placed.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "copies",
                         "from_1", "to_1", "from_2", "to_2", "key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as the plan takes them, all columns kept.

    Whole copies keep their text as it is; a part taken once more is the text of those words
    with the white space between them. Nothing is returned for rows that take nothing. Every
    row is taken as its own plan row says, also where ids are null or shared.
    """
    rows, key = keyed_rows(docs)
    plan = mix_plan(rows, id_col, text_col, key_col=key, **settings).where("taken > 0")
    whole = F.when(F.col("copies") > 0, F.array_repeat(F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b")),
                                                        F.col("copies").cast("int"))).otherwise(F.array())
    part = F.filter(F.array(*[F.struct(F.col(f"from_{i}").alias("a"), F.col(f"to_{i}").alias("b")) for i in ("1", "2")]),
                    lambda r: r["b"] > r["a"])
    takes = plan.select(F.col("key").alias(key), F.concat(whole, part).alias("_mix_takes"))
    joined = rows.join(takes, key).withColumn("_mix_take", F.explode("_mix_takes"))
    # words, each with the white space after it (the split keeps every character)
    pieces = F.split(F.regexp_replace(F.col(text_col), f"^{SPACE}", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    text = F.when(F.col("_mix_take.a").isNull(), F.col(text_col)).otherwise(F.regexp_replace(
        F.concat_ws("", F.slice(pieces, F.col("_mix_take.a").cast("int") + 1, (F.col("_mix_take.b") - F.col("_mix_take.a")).cast("int"))),
        f"{SPACE}$", ""))
    return joined.withColumn(text_col, text).select(*docs.columns)
