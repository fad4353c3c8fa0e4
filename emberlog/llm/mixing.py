"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, shared_dir, stored, word_count

WEIGHTS = (5, 2, 1)
#: Words of a block at most, blocks that the smallest target holds at least, and words of the
#: shards that a source is dealt into.
BLOCK, FINE, SHARD = 32, 16, 2_000_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add target to sources(source, source_size), one row for each source.

    Sources by code point, null last, weigh `weights`, repeating. They share `share` of all
    words by weight; no target exceeds `cap` times its source, and what is over goes to the
    others by weight until none is above. That is min(cap * size, level * weight) at one level
    for all, found with running sums over the sources in the order in which they fill up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("_full", "_rank")
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sources.select("source", "source_size", F.row_number().over(by_name).alias("_rank"))
        .withColumn("_w", w)
        .withColumn("_full", cap * F.col("source_size") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("_w").over(rest))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_rank", "_level"))).over(everything)["_level"])
        .withColumn("target", F.coalesce(F.least(cap * F.col("source_size"), F.col("_level") * F.col("_w")), cap * F.col("source_size")))
        .select("source", "source_size", "target")
    )


def apportion(rows: DataFrame, party: list[str], votes: str, seats: str, of: list[str]) -> DataFrame:
    """Add quota: Sainte-Laguë seats of each party among the parties that share `of`.

    `seats` is the number to give within `of`; the (k+1)-th seat of a party has the quotient
    votes / (2k + 1), and the highest quotients win, ties to the smaller party. The seats
    that are certain (at a divisor that cannot give too many) are given at once; only the
    quotients of the remaining ones, about three for each party, are laid out and ranked.
    """
    group = Window.partitionBy(*of)
    n = F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(group)
    total = F.sum(votes).over(group)
    sure = F.when(total > 0, F.floor(F.col(votes) * F.greatest(F.col(seats) - n / 2, F.lit(0.0)) / total + 0.5)).otherwise(0).cast("long")
    base = rows.withColumn("_more", F.when(total > 0, F.ceil(F.col(votes) * n / total) + 2).otherwise(0).cast("int")).withColumn("_sure", sure)
    base = base.withColumn("_open", (F.col(seats) - F.sum("_sure").over(group)).cast("long"))
    bids = base.where(F.col(votes) > 0).select(*dict.fromkeys(party + of), "_open", F.explode(F.transform(F.sequence(F.lit(0), F.col("_more")), lambda k: F.col(votes) / (2 * (F.col("_sure") + k) + 1))).alias("_q"))
    ranked = bids.withColumn("_r", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("_q"), *[F.asc_nulls_last(c) for c in party])))
    won = ranked.where("_r <= _open").groupBy(*party).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(party)], "_won")
    on = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(party)]
    return base.join(won, on, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sure", "_more", "_open", "_won", *[f"_p{i}" for i in range(len(party))])


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    """What the mix needs of each row: its id, source, size, and a hash that tells texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text")).alias("text_hash"), *[F.col(c).alias(f"_{c}") for c in more])


def mix(docs: DataFrame, **kwargs) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): what the mix takes of it.

    doc_id, source, size (words), source_size, target (of its source), taken (words, repeats
    counted), whole (times that the mix takes all of it), cut_from and cut_words (one more
    part of it, after which words and how many), wrap_words (one more part from its start).

    A source's documents, dealt into shards by hash, stand in seeded order and are cut into
    blocks of `block` words, or of fewer, down to one, where the smallest target would hold under
    FINE blocks. Quotas of blocks go to sources, then within a source to its shards. A shard
    takes all its blocks as often as its quota allows, and then, from a seeded start, the
    following ones, going round at the end: so most documents are taken whole. Nothing is taken
    more than `cap` times. A null source is a source; texts that are null or without words have
    size 0 and nothing is taken; long texts are cut like others; repeated rows keep a row each;
    an empty table gives an empty result; extra columns are ignored; reruns agree, since rows
    alike in id, size and text are interchangeable.
    """
    sized = stored(_sized(docs), shared_dir(docs.sparkSession), "sized")
    return _plan(sized, **kwargs).select("doc_id", "source", "size", "source_size", "target", "taken", "whole", "cut_from", "cut_words", "wrap_words")


def _plan(sized: DataFrame, seed: int = 11, block: int = BLOCK, shard: int = SHARD, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The decisions of mix for the rows of _sized, a stored table, with all its columns."""
    folder = shared_dir(sized.sparkSession)
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    aimed = stored(targets(sources, weights, share, cap).withColumn("_one", F.lit(1)), folder, "targets")
    # an equal-token block is the unit of all quotas; a source gets as many as its target holds
    least = aimed.where("target > 0").agg(F.min("target")).first()[0] or 0.0
    while block > 1 and least < FINE * block:
        block //= 2
    blocks = aimed.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy("_one")) / block).cast("long"))
    quotas = stored(apportion(blocks, ["source"], "target", "seats", ["_one"]).select("source", "source_size", "target", F.col("quota").alias("source_quota"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("int").alias("shards")), folder, "quotas")
    alike = ["doc_id", "size", "text_hash"]
    # rows without words are taken by none, so no shard has to order them
    blank = sized.where("size = 0").join(quotas.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    blank = blank.select("*", *[F.lit(0).cast("long").alias(c) for c in ("whole", "cut_from", "cut_words", "wrap_words", "taken")])
    dealt = (
        sized.where("size > 0")
        .join(quotas.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), *alike), F.col("shards")).cast("int"))
    )
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").cast("long").alias("shard_size"), F.max("source_quota").alias("source_quota"))
    got = apportion(shards, ["source", "shard"], "shard_size", "source_quota", ["source"])
    got = got.select(
        F.col("source").alias("_s"),
        F.col("shard").alias("_k"),
        "shard_size",
        F.least(F.col("quota") * block, F.floor(F.col("shard_size") * cap)).cast("long").alias("_take"),
        F.when(F.col("shard_size") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block))) * block).otherwise(0).cast("long").alias("_start"),
    )
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), *alike), *[F.asc_nulls_last(c) for c in alike])
    placed = dealt.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = F.col("shard_size")
    lo, hi = F.col("_end") - F.col("size"), F.col("_end")
    stop = F.col("_start") + F.col("_rem")
    planned = (
        placed.join(got, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_k")))
        .withColumn("whole", F.when(n > 0, F.floor(F.col("_take") / n)).otherwise(0).cast("long"))
        .withColumn("_rem", F.col("_take") - F.col("whole") * n)
        .withColumn("cut_from", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_start") - lo)))
        .withColumn("cut_words", F.greatest(F.lit(0), F.least(hi, stop) - F.greatest(lo, F.col("_start"))).cast("long"))
        .withColumn("wrap_words", F.greatest(F.lit(0), F.least(hi, stop - n) - lo).cast("long"))
        .withColumn("whole", F.when(F.col("size") > 0, F.col("whole")).otherwise(0))
        .withColumn("cut_from", F.col("cut_from").cast("long"))
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("cut_words") + F.col("wrap_words"))
    )
    return planned.select(blank.columns).unionByName(blank)


def apply_mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The mixed corpus, with the columns of docs: each text as often as the mix takes it.

    Cut parts hold the taken words joined by spaces, and n_chars (where there is one) their
    length. Rows are numbered and stored first, so that each meets its own decision however many
    are alike; columns of any name go along.
    """
    row, plan, new = fresh(docs.columns, "_row", "_plan", "_text")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), shared_dir(docs.sparkSession), "rows")
    planned = _plan(stored(_sized(rows, row), shared_dir(docs.sparkSession), "sized"), **kwargs)
    planned = planned.where("taken > 0").select(F.col(f"_{row}").alias(row), F.struct("size", "whole", "cut_from", "cut_words", "wrap_words").alias(plan))
    p = F.col(plan)
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    none = F.array().cast("array<string>")

    def part(start, n):
        cut = F.array_join(F.slice(words, (start + 1).cast("int"), n.cast("int")), " ")
        return F.when(n == 0, none).when(n == p["size"], F.array("text")).otherwise(F.array(cut))

    parts = F.concat(F.array_repeat(F.col("text"), p["whole"].cast("int")), part(p["cut_from"], p["cut_words"]), part(F.lit(0), p["wrap_words"]))
    fields = {"text": F.col(new), "n_chars": F.length(new).cast("long")}
    return rows.join(planned, row).withColumn(new, F.explode(parts)).select([fields.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
