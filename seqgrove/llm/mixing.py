"""Mixing sources to target weights: hash-random keys, distributed prefix sums, exact cuts.

Every document gets a random key from a hash of its id. The first bits of the key deal each source
out to buckets, so a source with most of the rows spreads like any other; bucket totals give each
bucket its offset, and a running sum inside a bucket gives the document's exact position among the
words of its source. A source's budget is then cut there: whole epochs first, then the documents whose
middle lies before the remainder, so the words taken miss the target by at most half a document.

Defined cases: null text has size 0; a null source is a source of its own, after all others; rows with
equal ids share a key and are ordered by size; a source without words has target 0 and its documents
are taken once; very long texts are counted whole; an empty table gives an empty mix; further columns are not read, and
``mixed_documents`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size -> target: shares of the total by weight, at most ``most`` times the size.

    Water filling in closed form: in the order of most * size / weight, a source is capped while its
    share of what is left reaches its cap. All comparisons are of whole numbers. One row a source.
    """
    null_last = [F.col("source").isNull().cast("int"), F.col("source")]
    pos = F.row_number().over(Window.orderBy(*null_last)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("pos", pos).withColumn("weight", weight.cast("decimal(38,0)")).withColumn("cap", (F.col("source_size") * most).cast("decimal(38,0)"))
    order = Window.orderBy((F.col("source_size").cast("double") / F.col("weight").cast("double")), "pos")
    upto, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("decimal(38,0)"))
    s = s.withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0)).cast("decimal(38,0)"))
    s = s.withColumn("left_weight", F.sum("weight").over(rest).cast("double"))
    level = F.col("left_words").cast("double") / F.col("left_weight")
    share = level * F.col("weight").cast("double")
    s = s.withColumn("free", (share < F.col("cap").cast("double"))).withColumn("level", level)
    # the first source that isn't capped fixes the level for all after it
    s = s.withColumn("fixed", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("fixed").isNull(), F.col("cap").cast("double")).otherwise(F.col("fixed") * F.col("weight").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix", bucket_bits: int = 12, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs and taken (epochs * size), with ``keep``."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), *kept)
    digits = -(-bucket_bits // 4)
    bucket = F.shiftright(F.conv(F.substring("key", 1, digits), 16, 10).cast("int"), 4 * digits - bucket_bits)
    d = d.withColumn("bucket", bucket)
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "bucket", before.alias("before"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select("o.source", "o.bucket", "before", "source_size", "target")
    d = d.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source and d.bucket = p.bucket")).select("d.*", "before", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    d = d.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    some = (2 * start + F.col("size") <= 2 * rest).cast("bigint")
    d = d.withColumn("epochs", F.col("whole") + some)
    return d.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), *[F.col(f"keep_{c}") for c in keep])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Documents without words ride along once.

    The mix is made of ids and sizes; texts move once, to meet their epochs. Rows that are equal in every column
    share theirs out evenly, the first getting one more."""
    keys = [F.xxhash64(*docs.columns).alias("h1"), F.xxhash64(F.lit(7), *docs.columns).alias("h2")]
    m = mix(docs.select("doc_id", "text", "source", *keys), weights=weights, most=most, seed=seed, keep=("h1", "h2"))
    times = F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.lit(1))
    plan = m.groupBy(F.col("keep_h1").alias("h1"), F.col("keep_h2").alias("h2")).agg(F.sum(times).alias("times"), F.count("*").alias("rows")).where("times > 0")
    found = docs.select(F.struct(*docs.columns).alias("row"), *keys).join(plan, ["h1", "h2"])
    turn = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.lit(1))) - 1  # dealt and sorted so already
    share = F.floor(F.col("times") / F.col("rows")) + (F.col("turn") < F.col("times") % F.col("rows")).cast("int")
    both = found.withColumn("turn", turn).select("row", share.alias("n")).where("n > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("again")).select("row.*")
