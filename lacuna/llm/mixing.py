"""Mixing sources to target shares by systematic sampling.

A source's documents are laid out in a line, each as long as its expected
copies; with one random offset a document comes out once for each integer
boundary in its stretch.  All documents of a source expect the same number of
copies, so a stretch's place is the document's rank times that number.  Ranks
follow size, so that what is drawn has the sizes of the whole: the tokens drawn
miss the target by about one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.draws import uniform
from lacuna.plans.runtime import Scratch

SPREAD = 64


def source_key(col: Column) -> Column:
    """Sources compare after trimming and lower-casing."""
    return F.lower(F.regexp_replace(col, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))


def plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens_available, tokens_target, expected_copies) for every source of targets.

    docs: (source key, n_tokens).  The total is the token count of all documents
    of the target sources, or what the scarcest source allows with every
    document at its repeat cap.  A target whose source has no tokens cannot be
    met: the others keep their proportions and it is reported with 0 tokens.
    Targets of null, non-positive share or repeats draw nothing.
    """
    have = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens_available"))
    want = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    # A source stated twice: shares add up, the tighter cap holds.
    want = want.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    t = want.join(have, "source", "left").na.fill(0, ["docs", "tokens_available"])
    usable = F.expr("coalesce(tokens_available > 0 and target_share > 0 and max_repeats > 0, false)")
    t = t.withColumn("share", F.when(usable, F.col("target_share")).otherwise(0.0))
    all_rows = Window.partitionBy(F.lit(1))  # one row a target source
    t = t.withColumn("share", F.expr("try_divide(share, sum(share) over ())"))
    t = t.withColumn("total", F.least(F.sum(F.when(usable, F.col("tokens_available"))).over(all_rows).cast("double"), F.min(F.when(usable, F.expr("max_repeats * tokens_available / share"))).over(all_rows)))
    t = t.withColumn("tokens_target", F.coalesce(F.expr("total * share"), F.lit(0.0)))
    return t.withColumn("expected_copies", F.coalesce(F.expr("least(try_divide(tokens_target, tokens_available), cast(max_repeats as double))"), F.lit(0.0))).drop("share", "total")


def mix(docs: DataFrame, targets: DataFrame, key: str, source: str, size: str, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares) of a mix.

    drawn: (doc key, source, n_tokens, copy_no), one row for each copy.  shares:
    for every target source its target and actual share, tokens, documents and
    largest number of copies.  Documents with a null source or one that no
    target names take no part, nor do documents of no tokens (null and empty texts);
    empty tables give empty results.  A source with most of the rows is ranked
    in ``SPREAD`` parts for each size, so no task holds a source.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    picked = docs.select(F.col(key).alias("k"), source_key(F.col(source)).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n_tokens"))
    picked = scratch.save(picked.where("source is not null and n_tokens > 0"), "sizes")
    todo = scratch.save(plan(picked.select("source", "n_tokens"), targets), "plan")
    rate = F.broadcast(todo.where("expected_copies > 0").select("source", "max_repeats", "expected_copies"))  # one row a target source
    part = F.pmod(F.xxhash64("k"), F.lit(SPREAD)).alias("part")
    ranked = picked.select("*", part)
    cells = ranked.groupBy("source", "n_tokens", "part").agg(F.count("*").alias("n"))
    # Offsets: first by size within a source (one row a size), then by part within a size.
    sizes = cells.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
    before = sizes.select("source", "n_tokens", (F.sum("n").over(Window.partitionBy("source").orderBy("n_tokens")) - F.col("n")).alias("smaller"))
    cells = cells.select("source", "n_tokens", "part", (F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("part")) - F.col("n")).alias("earlier"))
    offsets = cells.join(before, ["source", "n_tokens"]).select("source", "n_tokens", "part", (F.col("smaller") + F.col("earlier")).alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "n_tokens", "part").orderBy("k"))
    ranked = ranked.withColumn("place", place).join(offsets, ["source", "n_tokens", "part"]).join(rate, "source")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place"))
    offset = uniform(F.lit(seed), F.col("source"))
    crossed = F.floor(F.col("rank") * F.col("expected_copies") + offset) - F.floor((F.col("rank") - 1) * F.col("expected_copies") + offset)
    drawn = ranked.withColumn("copies", F.least(crossed, F.col("max_repeats")).cast("int")).where("copies > 0").select("k", "source", "n_tokens", "copies")
    drawn = scratch.save(drawn, "drawn")
    got = drawn.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_mix"), F.max("copies").alias("most_copies"))
    shares = todo.join(F.broadcast(got), "source", "left").na.fill(0, ["docs_used", "tokens_mix", "most_copies"])
    shares = shares.withColumn("actual_share", F.coalesce(F.expr("try_divide(tokens_mix, sum(tokens_mix) over ())"), F.lit(0.0)))
    copies = drawn.select(F.col("k").alias(key), "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))
    return copies, shares.select("source", "target_share", "actual_share", "max_repeats", "most_copies", "docs", "docs_used", "tokens_available", F.col("tokens_target"), "tokens_mix")
