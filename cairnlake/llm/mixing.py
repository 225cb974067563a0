"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from the weights, capped at twice a source's words, the excess reshared by weight.
The mix is N blocks of BLOCK words. Sainte-Laguë gives each source its blocks, and then each
shard of a source (one or more hash buckets of its documents) its share of them: both times the N highest
quotients votes / (2 k + 1) win. Each divisor is known to within half a block per party, so only
a few quotients per party compete and nothing of N's size is listed. A shard's documents stand
in a seeded order on a circle of words; it takes whole turns and then a seeded run of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, stored, table, word_count

#: Weights by rank of the source, repeating; the share of all words that the mix has.
WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), 1.5, 2
#: Words in a block; words in a shard, about, and the shards at which they grow instead; seed
#: of the order and of the first block.
BLOCK, SHARD_WORDS, MANY_SHARDS, SEED = 32, 100_000, 100_000, 20240607
#: Blocks that a source's words make at least for each of its shards: what a shard can't take of
#: its quota is lost, less than a block, so shards must be much larger than one.
SHARD_BLOCKS = 100


def capped_targets(sources: DataFrame, share: float = SHARE, times: float = MOST_TIMES) -> DataFrame:
    """sources(source, weight, source_size) with target: min(times * size, level * weight),
    the level being the one at which the targets add up to share * all sizes.

    One row per source, so its windows hold a row per source, not per document.
    """
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, rest = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    out = sources.withColumn("cap", F.col("source_size") * F.lit(float(times)))
    out = out.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    # if all before this source are capped and this is the first that is not, the level is:
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest))
    first = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(rank).alias("at"), F.col("level")))
    out = out.withColumn("first", first).withColumn("level", F.min("first").over(Window.partitionBy())["level"])
    return out.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).drop("cap", "total", "level", "first")


def sainte_lague(parties: DataFrame, within: Sequence[str], party: str, votes: str, seats: Column | str, out: str) -> DataFrame:
    """parties with the seats that each wins of those of its group, ties to the smaller party.

    `seats` is the same for all rows of a group. The winning divisor lies between V/(N + K/2)
    and V/(N - K/2) for V votes, N seats and K parties, so a party surely has the seats that
    the larger gives it, and competes for those up to what the smaller gives it.
    """
    group = Window.partitionBy(*within)
    # row_number orders ties; the frame over the group holds one row per party
    df = parties.withColumn("_n", F.expr(seats) if isinstance(seats, str) else seats)
    df = df.withColumn("_v", F.sum(votes).over(group)).withColumn("_k", F.count(F.lit(1)).over(group).cast("double"))
    got = lambda n: F.floor(F.col(votes) / F.col("_v") * n + 0.5)
    df = df.withColumn("_low", F.when((F.col("_v") > 0) & (F.col("_n") > F.col("_k") / 2), F.greatest(F.lit(0), got(F.col("_n") - F.col("_k") / 2) - 1)).otherwise(0))
    df = df.withColumn("_high", F.when(F.col("_v") > 0, got(F.col("_n") + F.col("_k") / 2) + 1).otherwise(0))
    df = df.withColumn("_left", F.col("_n") - F.sum("_low").over(group))
    bids = df.filter("_high > _low").select(*within, party, "_left", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_i"), F.col(votes).alias("_w"))
    order = Window.partitionBy(*within).orderBy((F.col("_w") / (2 * F.col("_i") + 1)).desc(), F.col(party).asc_nulls_last())
    won = bids.withColumn("_r", F.row_number().over(order)).filter("_r <= _left").groupBy(*within, party).agg(F.count(F.lit(1)).alias("_won"))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*within, party)]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    joined = df.alias("a").join(won.alias("b"), on, "left")
    return joined.select("a.*", (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias(out)).drop("_n", "_v", "_k", "_low", "_high", "_left")


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, times: int = MOST_TIMES, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, mark (a hash of its text), size, source, source_size, target, shard, begin, taken, turns, cut_from.

    `taken` words of the document go to the mix: `turns` whole copies, and the rest from word
    `cut_from` on, around its end. A null text or one without words has size 0 and nothing is
    taken. A null source is a source of its own, the last. Rows with equal doc_id are separate
    documents; equal rows take part each for itself. An empty table gives an empty result.
    """
    sized = stored(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", F.lit(seed)).alias("mark")),
        "mix-sizes",
    )
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = min(MANY_SHARDS, max(1, -(-total // shard_words)))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)))
    buckets = stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    # a source's buckets are put together to as many shards as its own words allow
    own = F.greatest(F.lit(1), F.least(F.lit(shards), F.floor(F.col("source_size") / (block * SHARD_BLOCKS)))).cast("long")
    owns = sources.select(F.col("source").alias("o"), own.alias("own"))
    buckets = stored(buckets.join(owns, F.col("source").eqNullSafe(F.col("o"))).select(F.col("source").alias("bs"), F.col("bucket").alias("b"), "bucket_size", F.pmod("bucket", "own").alias("shard")), "mix-shards")
    cells = buckets.groupBy(F.col("bs").alias("source"), "shard").agg(F.sum("bucket_size").alias("cell_size"))
    nth = F.row_number().over(Window.orderBy(F.encode("source", "UTF-8").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    sources = capped_targets(sources.withColumn("weight", weight), share, times)
    sources = sources.withColumn("one", F.lit(1))
    blocks = F.round(F.sum("target").over(Window.partitionBy("one")) / block).cast("long")
    quotas = sainte_lague(sources, ["one"], "source", "target", blocks, "blocks").select(F.col("source").alias("s"), "source_size", "target", "blocks")
    cells = cells.join(quotas, F.col("source").eqNullSafe(F.col("s")))
    cells = sainte_lague(cells, ["source"], "shard", "cell_size", F.col("blocks"), "quota")
    words = F.least(F.col("quota") * block, F.col("cell_size") * times)
    cells = cells.select(
        F.col("source").alias("cs"), F.col("shard").alias("ch"), "source_size", "target", "cell_size",
        F.when(F.col("cell_size") > 0, F.floor(words / F.greatest("cell_size", F.lit(1)))).otherwise(0).cast("long").alias("turns"),
        F.when(F.col("cell_size") > 0, words % F.greatest("cell_size", F.lit(1))).otherwise(0).cast("long").alias("run"),
        (F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.greatest(F.floor(F.col("cell_size") / block), F.lit(1))) * block).cast("long").alias("first"),
    )
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", "mark", F.lit(seed + 1)), "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sharded = sized.join(buckets.drop("bucket_size"), F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("b")))
    placed = sharded.withColumn("end", F.sum("size").over(order)).withColumn("begin", F.col("end") - F.col("size"))
    placed = placed.join(cells, F.col("source").eqNullSafe(F.col("cs")) & (F.col("shard") == F.col("ch")))
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))
    stop = F.col("first") + F.col("run")
    ahead, wrapped = overlap(F.col("first"), F.least(stop, F.col("cell_size"))), overlap(F.lit(0), stop - F.col("cell_size"))
    return placed.select(
        "doc_id", "mark", "size", "source", "source_size", F.col("target").cast("double").alias("target"), "shard", "begin",
        (F.col("turns") * F.col("size") + ahead + wrapped).cast("long").alias("taken"), "turns",
        F.when(ahead > 0, F.greatest(F.lit(0), F.col("first") - F.col("begin"))).otherwise(0).cast("long").alias("cut_from"),
    )


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: documents' own columns, a row for each whole copy and one, cut to its
    words, for what is left over. Words of a cut text are joined by single spaces. Rows with
    equal doc_id and text share evenly what is taken of them."""
    taken = mix(documents.select("doc_id", "source", "text"), **how).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_m"))
    taken = taken.agg(F.floor(F.sum("taken") / F.count(F.lit(1))).alias("_t"), F.min("size").alias("_s"), F.min("cut_from").alias("_c")).filter("_t > 0")
    marked = documents.withColumn("_mark", F.xxhash64("text", F.lit(how.get("seed", SEED))))
    rows = marked.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m")))
    left = (F.col("_t") % F.col("_s")).cast("int")
    words = F.filter(F.split("text", rf"{BLANK}+"), lambda w: w != "")
    ring = F.concat(words, words)
    cut = F.array_join(F.slice(ring, (F.col("_c") + 1).cast("int"), left), " ")
    pieces = F.concat(F.array_repeat(F.col("text"), F.floor(F.col("_t") / F.col("_s")).cast("int")), F.when(left > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    kept = [c for c in documents.columns if c not in ("text", "n_chars")]
    out = rows.select(*kept, F.explode(pieces).alias("text"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*documents.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words, its source's target, and the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
