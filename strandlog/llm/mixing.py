"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm._common import WORD, stage

#: Weights of the sources in code-point order, repeating; null is the last source.
WEIGHTS = (3, 1, 2)
#: Of each weight, the share at the end of training over that at its start. A schedule is linear in time between the
#: two, and its integral over training is the source's target.
TREND = (0.5, 2.0, 1.0)
BUCKETS = 256


def size_of(text: str | Column = "text") -> Column:
    """Number of words: runs of anything but ASCII white space; of a null text 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key() -> Column:
    """A source's join key, never null: null and the empty string differ."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def targets(sizes: DataFrame, total: float = 1.5, cap: float = 2.0, weights=WEIGHTS, trend=TREND) -> DataFrame:
    """source, source_size, target, _taken_total (its rounded target) and trend of each source of sizes (source, size).

    Sources share `total` times the words of all by weight; a target stops at `cap` times its
    source's size, and what is over is shared by weight among the others until none is above.
    That is: target = least(cap * size, level * weight), with the level at which the targets
    sum up. It is found by windows over the sources in the order of cap * size / weight; these
    have one row a source, not one a document.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (rank % len(values)).cast("int") + 1)
    by = by.select("source", "source_size", pick([float(w) for w in weights]).alias("weight"), pick([float(t) for t in trend]).alias("trend"))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("reach", F.col("cap") / F.col("weight"))
    every, order = Window.partitionBy(), Window.orderBy("reach", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(total)) - capped) / rest)
    by = by.withColumn("first", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "level"))).over(every))
    by = by.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("first.level") * F.col("weight")), F.col("cap")))
    return by.select("source", "source_size", "target", F.round("target").cast("long").alias("_taken_total"), "trend")


def assign(docs: DataFrame, total: float = 1.5, cap: float = 2.0, weights=WEIGHTS, trend=TREND) -> DataFrame:
    """docs (doc_id, text, source and more) with size, source_size, target, taken, and where its words start in its source's demand.

    A source of target t and size s is gone through t div s times in whole; the last t mod s
    words are the first ones in an order of the documents that a digest of doc_id gives, so
    the mix takes exactly the rounded target of each source, in whole documents but for one a
    source. Ties of that order are broken by a digest of the text; rows equal in both are
    alike. taken is at most cap * size, rounded up.

    Sums over a source's documents are taken in two steps, within one of 256 buckets of the
    digest and over the buckets, so a source with a third of all rows is dealt to 256 window
    groups. A null source is a source; a null or empty text has size 0 and takes 0; a null
    doc_id has a digest of its own. A text may be of any length: its words are counted in place.
    No documents give no rows. Columns of docs are kept; those named like a new one are replaced.
    """
    return _placed(_sized(docs), total, cap, weights, trend)


def _sized(docs: DataFrame) -> DataFrame:
    """docs with size, the key of their source, and their place in its order: bucket, digest and tie."""
    new = ["size", "source_size", "target", "taken", "trend", "_key", "_digest", "_tie", "_bucket", "_before", "_repeats", "_extra", "_taken_total"]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = docs.withColumns({"size": size_of(), "_key": _key(), "_digest": digest, "_tie": F.md5(F.coalesce("text", F.lit("")))})
    return docs.withColumn("_bucket", F.conv(F.substring("_digest", 1, 2), 16, 10).cast("int"))


def _placed(docs: DataFrame, total: float, cap: float, weights, trend) -> DataFrame:
    """assign() of sized documents. The sums of the buckets, one row a source and bucket, are staged: words are not counted again for them."""
    ahead = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = docs.groupBy(F.col("_key").alias("k"), F.col("_bucket").alias("b")).agg(F.sum("size").alias("n"), F.first("source", True).alias("source"))
    buckets = stage(buckets, "mixing-buckets")
    buckets = buckets.withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    t = targets(buckets.select("source", F.col("n").alias("size")), total, cap, weights, trend).withColumn("t", _key()).drop("source")
    per = buckets.drop("source", "n").join(t, F.col("k") == F.col("t")).drop("t")
    out = docs.join(per, (F.col("_key") == F.col("k")) & (F.col("_bucket") == F.col("b"))).drop("k", "b")
    order = Window.partitionBy("_key", "_bucket").orderBy("_digest", "_tie")
    within = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_before", F.col("_ahead") + F.coalesce(within, F.lit(0)))
    out = out.withColumn("_repeats", F.when(F.col("source_size") > 0, F.expr("_taken_total div source_size")).otherwise(F.lit(0)).cast("long"))
    left = F.col("_taken_total") - F.col("_repeats") * F.col("source_size") - F.col("_before")
    out = out.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    return out.withColumn("taken", F.col("_repeats") * F.col("size") + F.col("_extra")).drop("_key", "_digest", "_tie", "_bucket", "_ahead")


def position(before: Column, target: Column, trend: Column) -> Column:
    """Training time, from 0 to 1, at which a source's demand reaches `before` words.

    The schedule of a source is linear in time, w(t) = w0 + (w1 - w0) t with w1 / w0 = trend,
    scaled to integrate to the target; its integral is inverted in closed form.
    """
    share = F.when(target > 0, F.least(F.lit(1.0), before / target)).otherwise(F.lit(0.0))
    slope = (trend - 1) / (trend + 1)  # w(t) = 1 - slope + 2 slope t
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / F.nullif(2 * slope, F.lit(0.0))
    return F.coalesce(root, share)


def emit(assigned: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each copy that the mix takes, in training order: columns of assigned, with copy (0 on), copy_words and position.

    The schedule's integral gives the cumulative demand of each source; a copy's words start
    at (copy * source_size + words before it), whose time is the copy's position. The rows are
    range-sorted by position. With whole, a document of which any words are taken in the last
    round is taken in whole there; else its text there is its first copy_words words, joined by
    spaces. Documents of which nothing is taken give no row.
    """
    copies = F.col("_repeats") + (F.col("_extra") > 0).cast("int")
    out = assigned.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    out = out.withColumn("copy_words", F.when((F.col("copy") < F.col("_repeats")) | F.lit(whole), F.col("size")).otherwise(F.col("_extra")))
    out = out.withColumn("position", position(F.col("copy") * F.col("source_size") + F.col("_before"), F.col("_taken_total").cast("double"), F.col("trend")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col("copy_words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("copy_words") < F.col("size"), cut).otherwise(F.col("text")))
    return out.orderBy("position", "doc_id")


def mixed(docs: DataFrame, total: float = 1.5, cap: float = 2.0, weights=WEIGHTS, trend=TREND) -> DataFrame:
    """The query's rows: doc_id, size, source_size, target, taken and first_position, in training order.

    Words are counted once, and no text is shuffled: sizes and digests are staged without it.
    """
    slim = stage(_sized(docs.select("doc_id", "text", "source")).drop("text"), "mixing-sizes")
    a = _placed(slim, total, cap, weights, trend)
    at = position(F.col("_before"), F.col("_taken_total").cast("double"), F.col("trend"))
    return a.select("doc_id", "size", "source_size", "target", "taken", F.round(at, 9).alias("first_position")).orderBy("first_position", "doc_id")
