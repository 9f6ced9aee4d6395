"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to a token budget, whole epochs first.

Sources in order of code points (null last) weigh WEIGHTS, repeating, and share SHARE of all words. No source is taken
more than CAP times; what a cap cuts off is shared again by weight. A source is taken in whole epochs, and then in part:
documents in order of -ln(u) / quality, as long as their sum stays within what is left, and one further document of
the bucket at that edge if it brings the sum nearer. u is a hash of the row, so reruns agree.

Prefix sums are taken in two levels, over buckets of keys and inside the one bucket where the budget ends, so the
documents of a hot source never meet in one task. DataFrame functions only.

Defined results: null text has size 0; the null source is a source of its own; a source of size 0 has target 0 and none of
its documents is taken; an empty document of another source is taken in every whole epoch, and in the part if its key
lies before the end of the part, so never more than CAP times; rows that agree in doc_id, source and size are taken together or not at all; an empty table has no rows; a document's extra
columns are never read by mix(), and kept by sample().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Most sources whose decisions are broadcast (a hundred bytes each, about), and parts of a source beyond that.
BROADCAST_SOURCES, SALTS = 50_000, 64
#: Rows of a bucket of keys, about; and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 256, 65_536
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    bare = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts of 4 to 12 characters a word, blanks included; else a quarter."""
    chars = F.char_length(text)
    return F.when((chars >= 4 * size) & (chars <= 12 * size), 1.0).otherwise(0.25)


def sampling_key(doc_id: Column, size: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 52 bits of an MD5."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size), one row each, with their target.

    Sorted by how soon a cap is reached, source k is capped if its share, with all before it capped, is above its cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("long")
    soon = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = soon.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    nothing = F.lit(0).cast("long")
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", CAP * F.col("source_size"))
        .withColumn("total", SHARE * F.sum("source_size").over(whole))
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), nothing))
        .withColumn("free", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), nothing))
        .withColumn("capped", F.col("cap") * F.col("free") <= F.col("weight") * (F.col("total") - F.col("caps")))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), nothing))
        .withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole))
        .select(
            "source", "source_size",
            F.when(F.col("capped"), F.col("cap").cast("double"))
            .otherwise(F.col("weight") * (F.col("total") - F.col("spent")) / F.col("open")).alias("target"),
        )
    )


def _lookup(rows: DataFrame, small: DataFrame, condition: Column, spread: Column, limit: int = BROADCAST_SOURCES) -> DataFrame:
    """rows with what small, a stored table with a row for each source, has for theirs.

    Up to limit rows small is broadcast, so rows stay where they are. Beyond, rows are dealt by source and SALTS values of
    spread, and small is repeated for each, so no source is one task.
    """
    if small.count() <= limit:
        return rows.join(F.broadcast(small), condition)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    repeated = small.withColumn("_salted", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(repeated, condition & (F.col("_salt") == F.col("_salted"))).drop("_salt", "_salted")


def _keyed(docs: DataFrame) -> DataFrame:
    size = word_count(F.col("text"))
    sized = docs.select(F.col("doc_id").cast("long"), "source", size.alias("size"), F.col("text"))
    key = sampling_key(F.col("doc_id"), F.col("size"), quality_weight(F.col("text"), F.col("size")))
    return sized.select("doc_id", "source", "size", F.coalesce(key, F.lit(0.0)).alias("key"))


def _bucket(buckets: int) -> Column:
    return F.floor(buckets * F.col("key") / (1 + F.col("key")))


def decisions(rows: DataFrame) -> tuple[DataFrame, int]:
    """Per source: source_size, target, epochs, and where its fractional part ends; and the number of buckets."""
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    n = sums.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = (
        targets(sums.select("source", "source_size"))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    plan = stored(plan, "plan")
    rest = plan.select(F.col("source").alias("s"), "rest")
    counted = rows.groupBy("source", _bucket(buckets).alias("bucket")).agg(F.sum("size").alias("sum"))
    upto = F.sum("sum").over(W.partitionBy("source").orderBy("bucket"))
    edge = (
        counted.withColumn("upto", upto)
        .join(rest, F.col("source").eqNullSafe(F.col("s")))
        .where("upto > rest")
        .groupBy("s")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("sum")).alias("before"), "rest"), "bucket").alias("e"))
        .select("s", "e.*")
    )
    edge = stored(edge.withColumnRenamed("bucket", "edge"), "edge")
    at_edge = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("edge"))
    near = (
        _lookup(rows.withColumn("bucket", _bucket(buckets)), edge, at_edge, F.col("key"))
        .groupBy("s", "edge", "before", "rest", "key", "doc_id", "size")
        .agg(F.sum("size").alias("sum"))
    )
    place = F.struct("key", "doc_id", "size")
    upto = F.col("before") + F.sum("sum").over(W.partitionBy("s").orderBy("key", "doc_id", "size"))
    near = stored(near.select("s", "edge", "rest", "sum", "before", place.alias("place"), upto.alias("upto")), "near")
    inside = F.col("upto") <= F.col("rest")
    last = near.groupBy("s", "edge", "rest").agg(
        F.max(F.when(inside, F.col("place"))).alias("last"),
        (F.col("rest") - F.coalesce(F.max(F.when(inside, F.col("upto"))), F.max("before"))).alias("gap"),
    )
    left = near.where(~inside).select("s", "sum", "place")
    miss = F.abs(F.col("sum") - F.col("gap"))
    more = (
        left.join(last.select(F.col("s").alias("t"), "gap"), F.col("s").eqNullSafe(F.col("t")))
        .where((F.col("sum") > 0) & (miss < F.col("gap")))
        .groupBy("s")
        .agg(F.min(F.struct(miss.alias("miss"), "place")).alias("m"))
        .select(F.col("s").alias("u"), F.col("m.place").alias("more"))
    )
    ends = last.join(more, F.col("s").eqNullSafe(F.col("u")), "left").select("s", "edge", "last", "more")
    return stored(plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "ends"), buckets


def _times(buckets: int) -> Column:
    """How often a row is taken. Without a rest or an edge a source has nothing after its epochs."""
    bucket, place = _bucket(buckets), F.struct("key", "doc_id", "size")
    part = (bucket < F.col("edge")) | ((bucket == F.col("edge")) & (place <= F.col("last"))) | (place == F.col("more"))
    return F.col("epochs") + F.coalesce(part & (F.col("rest") > 0), F.lit(False)).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows = stored(_keyed(docs), "sized")
    plan, buckets = decisions(rows)
    plan = plan.withColumnRenamed("source", "of")
    return _lookup(rows, plan, F.col("source").eqNullSafe(F.col("of")), F.col("key")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times(buckets)).cast("long").alias("taken")
    )


def sample(docs: DataFrame, copy: str = "copy") -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns and the number of the copy (from 0).

    If docs has a column of that name, the number is called by it and underscores.
    """
    while copy.lower() in {c.lower() for c in docs.columns}:
        copy += "_"
    rows = stored(_keyed(docs), "sized")
    plan, buckets = decisions(rows)
    plan = plan.select(F.struct(*plan.columns).alias("_plan"))
    size = word_count(F.col("_doc.text"))
    sized = docs.select(F.struct(*docs.columns).alias("_doc")).withColumn("_size", size)
    joined = _lookup(sized, plan, F.col("_doc.source").eqNullSafe(F.col("_plan.source")), F.col("_doc.doc_id"))
    weight = quality_weight(F.col("_doc.text"), F.col("_size"))
    named = joined.select(
        "_doc", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"),
        F.coalesce(sampling_key(F.col("_doc.doc_id"), F.col("_size"), weight), F.lit(0.0)).alias("key"),
        "_plan.epochs", "_plan.rest", "_plan.edge", "_plan.last", "_plan.more",
    )
    times = named.select("_doc", _times(buckets).cast("int").alias("times")).where("times > 0")
    taken = times.select("_doc", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("_copy"))
    return taken.select("_doc.*", F.col("_copy").alias(copy))
