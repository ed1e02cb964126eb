"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled (by a hash of doc_id and text) into one stream of words, repeated as often
as its target asks for, and cut into blocks of ``block_words``; the last one ends at the target. As many slots
as there are blocks are filled by the golden-ratio sequence: its points, mapped through the cumulative numbers
of blocks, name a source each, so that every stretch of the mix has the sources near their weights. The n-th
slot of a source takes its n-th block; where the sequence gave a source a slot too few, it follows at the end.

Positions in a stream and ranks of slots are found in two levels (sums of buckets, then within a bucket), with
about sqrt(n) buckets, so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.common import stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 1024
BLOCKS_OF_SMALLEST = 64
GOLDEN = 0.6180339887498949
SLOTS_PER_BUCKET = 1 << 12
SPAN = 256
"""Cumulative blocks are cut into spans of this length, so that points meet sources by equality."""


def n_words(text: str = "text") -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    Sources weigh ``weights``, repeating, by code point with null last. Targets share the sum of all sizes by
    weight and stop at ``most`` times their source's size, the excess reshared by weight until none is above:
    with sources ordered by size over weight, the first ones stop, and the others share what is left.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("stops", F.col("top") <= F.col("level") * F.col("weight"))
    # a source stops only if all before it in the order do; the level of the first that does not holds for the rest
    rows = rows.withColumn("turn", F.row_number().over(order))
    rows = rows.withColumn("level", F.min(F.when(~F.col("stops"), F.struct("turn", "level"))).over(Window.partitionBy())["level"])
    target = F.when(F.col("level").isNull(), F.col("top")).otherwise(F.least("top", F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def streams(documents: DataFrame) -> DataFrame:
    """(row, doc_id, hash, source, size, begin): each document's place in its source's shuffled stream of words.

    ``row`` tells repeated rows apart.
    """
    rows = documents.select("doc_id", "source", n_words().alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    rows = stored(rows, "sized-documents")
    buckets = max(1, int(rows.count() ** 0.5))
    # the high bits choose the bucket, so buckets follow each other in the order of the hash
    rows = rows.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 33)) / F.lit((1 << 31) / buckets)).cast("int"))
    rows = rows.withColumn("order", F.struct("h", "doc_id"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("source", "bucket").orderBy("order")
    inside = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("doc_id", "source", "size", "bucket", "h", inside.alias("inside"), F.row_number().over(own).alias("nth"))
    joined = placed.join(sums, placed.source.eqNullSafe(sums.s) & (placed.bucket == sums.b))
    return joined.select(F.struct("bucket", "nth").alias("row"), "doc_id", F.col("h").alias("hash"), "source", "size", (F.col("base") + F.col("inside")).alias("begin"))


def schedule(spark, quotas: DataFrame, slots: int) -> DataFrame:
    """(slot, source, block): which block of which source each place of the mix takes; ``quotas`` is (source, blocks).

    ``slots`` is the sum of ``blocks``.
    """
    order = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = quotas.where("blocks > 0").withColumn("high", F.sum("blocks").over(order)).withColumn("low", F.col("high") - F.col("blocks"))
    span = F.sequence(F.floor(F.col("low") / SPAN), F.floor((F.col("high") - 1) / SPAN))
    bands = bands.select("source", "blocks", "low", "high", F.explode(span).alias("span"))
    point = F.col("id") * F.lit(GOLDEN) + F.lit(0.5)
    points = spark.range(slots).select(F.col("id").alias("slot"), F.floor((point - F.floor(point)) * slots).alias("u"))
    points = points.withColumn("span", F.floor(F.col("u") / SPAN))
    hit = points.join(bands, "span").where("u >= low and u < high")
    hit = hit.select("slot", "source", "blocks", F.floor(F.col("slot") / SLOTS_PER_BUCKET).alias("bucket"))
    counts = hit.groupBy("source", "bucket").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("slot")) - 1
    ranked = hit.withColumn("nth", nth).join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    ranked = ranked.select("slot", "source", (F.col("base") + F.col("nth")).alias("block"), "blocks").where("block < blocks")
    got = counts.groupBy("source").agg(F.sum("c").alias("got")).withColumnRenamed("source", "s")
    short = quotas.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < blocks")
    short = short.select("source", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("block"))
    return ranked.select("slot", "source", "block").unionAll(short.select((F.lit(slots) + F.col("block")).alias("slot"), "source", "block"))


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(plan, shares) for ``documents`` (doc_id, text, source, anything else).

    ``plan`` has a row (slot, source, block, row, doc_id, hash, size, epoch, first, words) for every piece of a
    document in a block: ``words`` words from word ``first`` of the document on, in the ``epoch``-th pass over the
    source. ``shares`` has a row (row, doc_id, size, source,
    source_size, target) per document. Documents without words take no part but have their row in ``shares``;
    with no words at all every target is 0. Rows with equal doc_id stay apart. Blocks are smaller where the
    smallest target would fill fewer than 64 of them, but no smaller than the whole mix over 2^20 blocks.
    """
    spark = documents.sparkSession
    docs = stored(streams(documents), "mix-streams")
    targets = source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = stored(targets.withColumn("words", F.least(F.round("target"), F.col("source_size") * F.lit(most)).cast("long")), "mix-targets")
    found = targets.agg(F.sum("words").alias("words"), F.min(F.when(F.col("words") > 0, F.col("words"))).alias("least")).head()
    size = max(1, min(block_words, (found["least"] or 0) // BLOCKS_OF_SMALLEST), min(block_words, (found["words"] or 0) >> 20))
    quotas = targets.select("source", F.ceil(F.col("words") / F.lit(size)).cast("long").alias("blocks"))
    slots = quotas.agg(F.coalesce(F.sum("blocks"), F.lit(0))).head()[0]
    tell = targets.withColumnRenamed("source", "s")
    shares = docs.join(tell, docs.source.eqNullSafe(tell.s)).drop("s")
    epoch = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / F.col("source_size")) - 1, F.lit(0)).cast("int")))
    pieces = shares.where("size > 0 and words > 0").select("row", "doc_id", "hash", "source", "size", "words", "begin", "source_size", epoch.alias("epoch"))
    begin = F.col("begin") + F.col("epoch") * F.col("source_size")
    pieces = pieces.select("row", "doc_id", "hash", "source", "size", "epoch", begin.alias("x"), F.least(begin + F.col("size"), F.col("words")).alias("y")).where("x < y")
    block = F.explode(F.sequence(F.floor(F.col("x") / size), F.floor((F.col("y") - 1) / size)))
    pieces = pieces.select("*", block.alias("block"))
    begin, end = F.greatest("x", F.col("block") * size), F.least("y", (F.col("block") + 1) * size)
    pieces = pieces.select("row", "doc_id", "hash", "size", "epoch", F.col("source").alias("s"), F.col("block").alias("b"), (begin - F.col("x")).alias("first"), (end - begin).alias("words"))
    slots_of = schedule(spark, quotas, slots)
    plan = slots_of.join(pieces, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    plan = plan.select("slot", "source", "block", "row", "doc_id", "hash", "size", "epoch", "first", "words")
    return plan, shares.drop("words", "begin", "hash")


def taken(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, source) of every document: words the mix takes, repeats counted.

    ``first_slot`` is the first place of the schedule that takes words of it, null where none does.
    """
    plan, shares = mix(documents, **options)
    got = plan.groupBy("source", "row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).withColumnsRenamed({"source": "s", "row": "r"})
    rows = shares.join(got, shares.source.eqNullSafe(got.s) & (shares.row == got.r), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", "source")


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``documents`` (doc_id, text, source, anything else): one row per document and pass.

    A document taken whole keeps its text; where a source's last pass ends within a document, that row has its
    first words only, joined by spaces. ``n_chars``, where there is one, follows the text. The amounts are those of the mix; its order is
    not in these columns.
    """
    plan, _ = mix(documents, **options)
    rows = plan.groupBy("hash", "doc_id", "source", "row", "epoch", "size").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    rows = rows.select(F.col("hash").alias("h"), F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("whole"), "first", "words")
    # the document as one struct, so that its columns may have any names
    hashed = documents.select(F.struct(*documents.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("hash"))
    # rows that repeat doc_id, text and source are one here; the plan has each of them
    nth = F.row_number().over(Window.partitionBy("hash", "doc.doc_id", "doc.source").orderBy(F.lit(0)))
    hashed = hashed.withColumn("nth", nth).where("nth = 1")
    met = hashed.join(rows, (F.col("hash") == F.col("h")) & F.col("doc.doc_id").eqNullSafe(F.col("d")) & F.col("doc.source").eqNullSafe(F.col("s")))
    part = F.array_join(F.slice(F.expr("regexp_extract_all(doc.text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"), F.col("first").cast("int") + 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("whole"), F.col("doc.text")).otherwise(part)
    own = {"text": text}
    if "n_chars" in documents.columns:
        own["n_chars"] = F.length(text).cast(documents.schema["n_chars"].dataType)
    return met.select(*(own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in documents.columns))
