"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks. DataFrame functions only.

1. Targets. A source's share of `total_share` times all words follows its weight, but stops at `max_copies`
   times its size; what is cut off is shared again by weight until no source is above (water filling).
2. Blocks. A source is dealt into shards of about `shard_words` words by a hash of the document id; in a
   shard the documents lie one behind the other in a seeded order, cut into equal blocks (they differ by one
   word at most) of about `block_words` words.
3. Quotas. All blocks to take are allotted to the sources by highest quotients votes / (2k - 1), where a
   source's votes are its target counted in its own blocks; then each source's seats go to its shards
   the same way. No source and no shard gets more than `max_copies` times its blocks.
4. Selection. Each block of a shard is taken quota div blocks times, and a seeded choice of the rest once
   more. A document's `taken` words are the overlaps with its blocks, counted with their copies.

The tables that are sorted as a whole have one row per source, or a few candidate quotients per source
or shard; documents are only ever sorted within a shard, so a hot source spreads over its shards.

Edge cases: a null text has size 0 and takes nothing; null is a source of its own, last in order; a null
id hashes as empty text; repeated rows are laid out one behind the other; an empty table gives no rows; a
table without words gives targets of 0. Equal quotients go to the source or shard that is first in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aquifer.llm.common import WORD, freeze, keyed

#: Weights of the sources in code point order, repeating: fixed by the contract.
CYCLE = (5, 2, 1)


def source_targets(rows: DataFrame, total_share: float, max_copies: int, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_no, source_size, weight, target) from rows of (source, size)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    n = F.row_number().over(order)
    named = sums.withColumn("source_no", n).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") - 1) % len(weights) + 1))
    cap = (F.col("source_size") * max_copies).cast("double")
    all_rows = Window.partitionBy(F.lit(1))
    fill = Window.orderBy("ratio", "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (named.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
             .withColumn("wanted", F.sum("source_size").over(all_rows) * total_share)
             .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / F.sum("weight").over(rest)))
    met = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                   F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no"))).over(all_rows)
    return level.withColumn("met", met).select(
        "source", "source_no", "source_size", "weight",
        F.when(F.col("met").isNull(), F.col("cap")).otherwise(
            F.least(F.col("cap"), F.col("weight") * F.col("met"))).alias("target"))


def sainte_lague(units: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add `quota` to rows of (votes, cap, seats): seats of the group by highest quotients votes / (2k - 1).

    Seats that every divisor near the right one gives are counted at once; only the few quotients around the
    last seat are listed and ranked, about three for a unit, however many seats there are.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    ranked = whole.orderBy(F.desc("quotient"), *order, "k")
    n, votes = F.count(F.lit(1)).over(whole), F.sum("votes").over(whole)
    share = F.when(F.col("__votes") > 0, F.col("votes") / F.col("__votes")).otherwise(0.0)
    low = F.floor(share * F.greatest(F.col("seats") - F.col("__n") / 2, F.lit(0.0)) + 0.5) - 1
    high = F.floor(share * (F.col("seats") + F.col("__n")) + 0.5) + 1
    bounds = (units.withColumn("__n", n).withColumn("__votes", votes)
              .withColumn("__low", F.greatest(F.least(low, F.col("cap")), F.lit(0)).cast("long"))
              .withColumn("__high", F.least(high, F.col("cap")).cast("long"))
              .withColumn("__left", F.col("seats") - F.sum("__low").over(whole)))
    listed = F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low") + 1, F.col("__high")))
    tried = bounds.withColumn("k", F.explode_outer(listed)).withColumn(
        "quotient", F.when(F.col("k").isNotNull() & (F.col("votes") > 0), F.col("votes") / (2 * F.col("k") - 1)))
    won = F.col("quotient").isNotNull() & (F.row_number().over(ranked) <= F.col("__left"))
    keys = [c for c in units.columns]
    return (tried.withColumn("__won", won.cast("long")).groupBy(*keys, "__low")
            .agg(F.sum("__won").alias("__more")).withColumn("quota", F.col("__low") + F.col("__more"))
            .drop("__low", "__more"))


def layout(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source", doc_id: str = "doc_id",
           total_share: float = 1.5, max_copies: int = 2, weights: tuple[int, ...] = CYCLE,
           block_words: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """`keep` columns of every row, with its place in its shard, the shard's quota and its `taken` words."""
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    narrow = docs.select(
        *[F.col(c).alias(f"keep_{c}") for c in keep], F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), id_text).cast("binary")).alias("h"), F.xxhash64(text).alias("tie"))
    rows = freeze(narrow, "mix-sizes")
    targets = source_targets(rows, total_share, max_copies, weights).withColumn(
        "shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
    targets = freeze(targets, "mix-targets")
    named = targets.withColumnRenamed("source", "__source")
    dealt = rows.join(named, rows["source"].eqNullSafe(named["__source"])).drop("__source").withColumn(
        "shard", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("shards"))
    shard = Window.partitionBy("source_no", "shard")
    placed = dealt.withColumn("start", F.sum("size").over(
        shard.orderBy("h", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    words = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size")).withColumn(
        "blocks", F.ceil(F.col("shard_size") / block_words).cast("long"))
    by_source = words.groupBy("source_no").agg(F.sum("blocks").alias("source_blocks"))
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size"))
    sources = targets.join(by_source, "source_no").select(
        "source_no", "source_blocks", F.coalesce(votes, F.lit(0.0)).alias("votes"),
        (F.col("source_blocks") * max_copies).alias("cap"))
    sources = sources.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy(F.lit(1)))).cast("long"))
    seats = sainte_lague(sources, [], ["source_no"]).select("source_no", F.col("quota").alias("seats"))
    quotas = sainte_lague(
        words.join(seats, "source_no").withColumn("votes", F.col("blocks").cast("double"))
        .withColumn("cap", F.col("blocks") * max_copies), ["source_no"], ["shard"])
    quotas = freeze(quotas.select("source_no", "shard", "shard_size", "blocks", "quota"), "mix-quotas")
    full = placed.join(quotas, ["source_no", "shard"])
    turn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "source_no", "shard").cast("binary")), 1, 8), 16, 10)
    full = full.withColumn("turn", turn.cast("long")).withColumn("end", F.col("start") + F.col("size"))
    taken = F.when(F.col("size") > 0, F.aggregate(
        block_range(), F.lit(0).cast("long"), lambda acc, i: acc + copies(i) * (block_end(i) - block_start(i))))
    return full.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))


def block_range() -> Column:
    """The numbers of the blocks that a row's words lie in."""
    first = F.expr("((start + 1) * blocks - 1) div shard_size")
    return F.sequence(first, F.expr("(`end` * blocks - 1) div shard_size"))


def block_start(i: Column) -> Column:
    """Where the row's words begin in block i, counted in the shard."""
    return F.greatest(F.col("start"), F.floor(i * F.col("shard_size") / F.col("blocks")))


def block_end(i: Column) -> Column:
    return F.least(F.col("end"), F.floor((i + 1) * F.col("shard_size") / F.col("blocks")))


def copies(i: Column) -> Column:
    """How often block i is taken. The step 2147483647 is a prime above any number of blocks, so that the
    places of a shard's blocks are a permutation."""
    place = (i * 2147483647 + F.col("turn")) % F.col("blocks")
    return (F.floor(F.col("quota") / F.col("blocks"))
            + F.when(place < F.col("quota") % F.col("blocks"), 1).otherwise(0)).cast("long")


def plan(docs: DataFrame, keep: list[str] = ["doc_id"], **options) -> DataFrame:
    """Each row's size, its source's size and target, and the words that the mix takes of it."""
    return layout(docs, keep, **options).select(
        *[F.col(f"keep_{c}").alias(c) for c in keep], "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", doc_id: str = "doc_id",
          max_copies: int = 2, **options) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each copy, with the words that the copy takes.

    A copy that takes all words keeps the text as it is; else the taken words are joined by one space. Rows
    that nothing is taken of go.
    """
    frozen, row = keyed(docs, doc_id)
    laid = layout(frozen, [row], text=text, doc_id=doc_id, max_copies=max_copies, **options).where("taken > 0").select(
        F.col(f"keep_{row}").alias("__row"), F.col("size").alias("__size"), "start", "end", "shard_size", "blocks",
        "quota", "turn")
    whole = frozen.select(F.col(row).alias("__row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    old = F.col("__doc").getField(text)
    # the words are taken apart once, below the explode: inside the lambda they would be for every block
    both = whole.join(laid, "__row").withColumn("__words", F.regexp_extract_all(old, F.lit(WORD), F.lit(0))).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.lit(max_copies))))
    spans = F.filter(block_range(), lambda i: copies(i) >= F.col("__copy"))
    words = F.flatten(F.transform(F.col("__spans"), lambda i: F.slice(
        F.col("__words"), (block_start(i) - F.col("start") + 1).cast("int"),
        (block_end(i) - block_start(i)).cast("int"))))
    got = (both.withColumn("__spans", spans).where(F.size("__spans") > 0)
           .withColumn("__got", words).where(F.size("__got") > 0))
    out = F.when(F.size("__got") == F.col("__size"), old).otherwise(F.array_join("__got", " "))
    fields = {c: F.col("__doc").getField(c) for c in docs.columns} | {text: out}
    if n_chars:
        fields[n_chars] = F.length(out).cast(docs.schema[n_chars].dataType)
    return got.select(*[x.alias(c) for c, x in fields.items()])
