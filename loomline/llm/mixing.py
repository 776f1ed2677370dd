"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, divided by its quality weight; smaller
keys come first.  A source's token target is met by as many complete epochs as
fit, then by the documents of the smallest keys whose sizes add up to the rest.
Prefix sums run over buckets of keys first; only the one bucket of each source
in which the rest runs out is ordered row by row, so a source that holds a third
of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise

#: Buckets of keys of each source.
BUCKETS = 4096
#: Targets stop at this many times the source's size.
CEILING = 3
#: Sources up to this many are broadcast with their decisions; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
WEIGHTS = (1, 2, 3)
#: Weights that quality() gives.
QUALITIES = (1.0, 0.5, 0.25)


def size(text: Column) -> Column:
    """Number of words of a text, split at ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(n_words: Column, n_bytes: Column) -> Column:
    """Weight of a document: 1 for texts of usual word length and some extent, less for others."""
    mean = n_bytes / F.greatest(n_words, F.lit(1))
    return F.when((mean >= 4) & (mean <= 12), 1.0).otherwise(0.5) * F.when(n_words >= 20, 1.0).otherwise(0.5)


def uniform(identity: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 digest."""
    word = F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), identity), "UTF-8")), 1, 13), 16, 10).cast("double")
    return (word + 0.5) / F.lit(float(2**52))


def identity() -> Column:
    """Stands for doc_id and text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """rows with _before, the number of rows before each in a total order, and _before_<c>, the sum of c over them.

    Rows are sorted by ranges; each range counts for itself, and only a row a
    range is summed in one place.  So no task gets all rows.
    """
    ranged = materialise(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    names = ["_before", *(f"_before_{c}" for c in sums)]
    own = ranged.withColumns(dict(zip(names, (F.coalesce(F.sum(c).over(w), F.lit(0)) for c in (F.lit(1), *sums)), strict=True)))
    whole = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_o{n}") for n, c in zip(names, (F.lit(1), *map(F.col, sums)), strict=True)))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_o{n}").over(ahead), F.lit(0)).alias(f"_o{n}") for n in names))  # a row a range
    out = own.join(F.broadcast(whole), F.col("_range") == F.col("_at"))
    out = materialise(out.select(*rows.columns, *((F.col(n) + F.col(f"_o{n}")).alias(n) for n in names)), "running")
    discard(ranged)
    return out


def targets(sources: DataFrame, share: float = 1.0) -> DataFrame:
    """Add weight and target to sources (source, source_size), a row a source and any number of them.

    Sources in code point order, null last, have the weights 1, 2, 3, repeating.
    All sizes together are shared by weight up to the ceiling of each source,
    the excess again by weight: targets are min(ceiling, level * weight), and the
    level follows from prefix sums in the order in which sources fill up.
    """
    s = running(sources.select("source", "source_size"), [F.col("source").isNull(), F.col("source")], [])
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("_before"), F.lit(len(WEIGHTS))).cast("int") + 1).cast("double")
    s = s.select("source", "source_size", weight.alias("weight"), (F.col("source_size").cast("double") * CEILING).alias("most"))
    all_ = s.agg((F.sum("source_size") * share).alias("total"), F.sum("weight").alias("weights")).first()
    ordered = running(s, [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")], ["most", "weight"])
    level = (F.lit(all_["total"]) - F.col("_before_most")) / (F.lit(all_["weights"]) - F.col("_before_weight"))
    ordered = ordered.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    # sources fill up in this order, so the level of the first that does not is that of all which follow
    final = ordered.agg(F.min(F.when(~F.col("full"), F.struct((F.col("most") / F.col("weight")).alias("at"), "level"))).alias("f")).first()["f"]
    final = F.lit(final["level"] if final else None).cast("double")
    target = F.when(F.col("full") | final.isNull(), F.col("most")).otherwise(F.least(F.col("most"), final * F.col("weight")))
    return ordered.select("source", "source_size", "weight", target.alias("target"))


def bucket(key: Column) -> Column:
    """The bucket of a key: its place among keys of all qualities alike, so that no quality fills a bucket with more than three times its share."""
    left = [F.exp(-key * q) / len(QUALITIES) for q in QUALITIES]
    return F.floor(BUCKETS * (1 - (left[0] + left[1] + left[2]))).cast("int")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Decide how many words the mix takes from each document.

    Only whole documents are taken: floor(target / source size) times each, and
    once more those whose keys come first, as long as they fit the rest; then
    the one document whose size comes nearest to what is still missing, if that
    brings the source nearer its target.  Null texts have size 0.  Keys depend
    on doc_id, text and seed, so reruns agree; rows equal in both are taken
    together or not at all.  Very long texts are counted whole.  An empty table gives
    an empty result; columns other than doc_id, text and source are ignored.

    Returns doc_id, size, source, source_size, target, taken, copies (taken as a
    number of whole documents) and _id, which stands for doc_id and text.
    """
    n = size(F.col("text"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n.alias("size"), identity().alias("_id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_bytes"))
    key = -F.log(uniform(F.col("_id"), seed)) / quality(F.col("size"), F.col("_bytes"))
    slim = slim.withColumn("key", key).withColumn("bucket", bucket(F.col("key"))).drop("_bytes")
    slim = materialise(slim, "keys")
    sums = materialise(slim.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    aims = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target") / F.greatest("source_size", F.lit(1)), 9))).otherwise(0).cast("long")
    aims = materialise(aims.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))), "targets")
    same = F.col("source").eqNullSafe(F.col("_s"))
    # the bucket of each source in which the rest runs out, and what the buckets before it take
    run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))).withColumnRenamed("source", "_s")
    cut = run.join(aims.select("source", "rest"), same).where("upto <= rest")
    cut = cut.groupBy("source").agg(F.max("bucket").alias("last"), F.max("upto").alias("before"))
    plan = aims.join(cut.withColumnRenamed("source", "_s"), same, "left").select("source", "source_size", "target", "epochs", "rest", F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("before", F.lit(0)).alias("before"))
    nexts = sums.withColumnRenamed("source", "_s").join(plan, same).where("bucket > last").groupBy("source").agg(F.min("bucket").alias("edge"))
    plan = materialise(plan.join(nexts.withColumnRenamed("source", "_s"), same, "left").select("source", "source_size", "target", "epochs", "rest", "last", "before", F.coalesce("edge", F.lit(BUCKETS + 1)).alias("edge")), "plan")
    small = plan.count() <= BROADCAST_SOURCES

    def with_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
        facts = facts.withColumnRenamed("source", "_s")
        return rows.join(F.broadcast(facts) if small else facts, same).drop("_s")

    # rows equal in key and identity are peers in this order: taken together or not at all
    edge = with_source(slim, plan).where("bucket = edge")
    edge = edge.withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy(F.struct("key", "_id"))))
    reached = materialise(edge.where("sum <= rest").groupBy("source").agg(F.max("sum").alias("reached"), F.max(F.struct("key", "_id")).alias("stop")), "edge")
    plan = plan.join(reached.withColumnRenamed("source", "_s"), same, "left").drop("_s").withColumn("gap", F.col("rest") - F.coalesce("reached", "before")).drop("reached", "before", "rest")
    chosen = (F.col("bucket") <= F.col("last")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(F.struct("key", "_id") <= F.col("stop"), F.lit(False)))
    # what is missing is filled by the document nearest in size among those not taken yet
    off = F.abs(F.col("size") - F.col("gap"))
    near = with_source(slim, plan).where(~chosen & (off < F.col("gap")))
    # equal rows are taken together, so they fill the gap with all their words
    near = near.groupBy("source", "_id").agg(F.sum("size").alias("size"), F.min("key").alias("key"), F.min("gap").alias("gap")).where(off < F.col("gap"))
    fill = materialise(near.groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", "_id")).alias("fill")), "fill")
    plan = materialise(plan.join(fill.withColumnRenamed("source", "_s"), same, "left").drop("_s"), "decisions")
    once = chosen | F.coalesce(F.col("_id") == F.col("fill._id"), F.lit(False))
    copies = F.col("epochs") + once.cast("long")
    return with_source(slim, plan).select("doc_id", "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "_id")


def repeat(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, all its columns, whatever their names.

    Rows without words (null and empty texts) are kept once; rows equal in
    doc_id and text are each taken as often.  An empty table stays empty.
    """
    decided = mix(docs, seed).groupBy("_id").agg(F.max("copies").alias("_copies"), F.max("size").alias("_size"))
    decided = decided.withColumnRenamed("_id", "_mix")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), identity().alias("_key")).join(decided, F.col("_key") == F.col("_mix"))
    times = F.when(F.col("_size") == 0, 1).otherwise(F.col("_copies")).cast("int")
    return rows.withColumn("_time", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select("_row.*")
