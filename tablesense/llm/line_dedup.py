"""Repeated runs of lines by a suffix array over line ids, in DataFrame operations only.

A document is its sequence of non-blank lines, all documents together are one text of line ids. Suffixes are
ranked by prefix doubling: ranks by the first h lines of two neighbouring stretches give the rank by 2h lines,
an integer in lexicographic order of line ids. Ranks are dense numbers over distinct pairs, found in two levels
(counts of rank ranges, then within a range). A suffix whose beginning occurs once has no repeat and drops out,
so each round works on repeats only.

A repeated run counts from ``min_chars`` characters on. For every suffix the shortest beginning of that many
characters has ``m`` lines; suffixes with the same first ``m`` lines are one interval of the suffix array with
a longest common prefix of at least ``m``. They have equal ranks over their first and their last 2^k lines, 2^k
being the largest power in ``m``. In each interval the first place in order of (doc_id, line) stays, all others
lose these lines. By this rule alone the last lines of a repeated run may stay: where fewer than ``min_chars``
characters of the run are left, the stretch from a line runs past its end.

With ``whole_runs``, which the query and its SQL take, the shortest stretch of ``min_chars`` characters that ends at
each line is matched too, by the same ranks. A line of a maximal repeated run has that many characters of the run behind it, or lies in the stretch
that ends with the run, so the run goes as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.common import stored

MIN_CHARS = 50
NO_ID = (1 << 63) - 1
RANGES = 1024
BROADCAST_NUMBERS = 4_000_000
"""Up to so many numbers in all, some 30 MB, the lines that go are broadcast to the texts; beyond, texts are shuffled."""

DOC = ["key", "content"]
PLACE = [*DOC, "pos"]


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), "text"
    )


def line_places(documents: DataFrame, min_chars: int, whole_runs: bool = False) -> DataFrame:
    """(key, content, pos, at, id, m, back): each non-blank line; ``at`` is its number in the text.

    ``m`` and ``back`` are the lines of the shortest stretches of ``min_chars`` characters that begin and that end
    with it, null near the end and near the beginning; ``back`` is there for whole runs only.
    """
    lines = _keyed(documents).select(*DOC, F.posexplode(F.split("text", "\n")).alias("at", "line")).where("line <> ''")
    lines = lines.select(*DOC, "at", F.xxhash64("line").alias("id"), F.length("line").cast("long").alias("chars")).dropDuplicates([*DOC, "at"])
    own = Window.partitionBy(*DOC).orderBy("at")
    before = F.sum("chars").over(own) - F.col("chars")
    rows = lines.withColumn("pos", F.row_number().over(own)).withColumn("before", before)
    rows = rows.withColumn("total", F.sum("chars").over(Window.partitionBy(*DOC)))
    reach = F.count("*").over(Window.partitionBy(*DOC).orderBy("before").rangeBetween(0, min_chars - 1))
    rows = rows.withColumn("m", F.when(F.col("total") - F.col("before") >= min_chars, reach))
    if not whole_runs:
        return rows.select(*PLACE, "at", "id", "m")
    after = F.col("before") + F.col("chars")
    behind = F.count("*").over(Window.partitionBy(*DOC).orderBy(after).rangeBetween(1 - min_chars, 0))
    return rows.select(*PLACE, "at", "id", "m", F.when(after >= min_chars, behind).alias("back"))


def _dense(pairs: DataFrame, low: int, width: int) -> DataFrame:
    """(a, b, rank) of distinct (a, b): dense ranks in order; ``a`` lies in ``low`` and the RANGES * ``width`` numbers after it."""
    # a - low may not fit in a long
    part = F.least(F.lit(RANGES - 1), F.floor((F.col("a").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / width)).cast("int")
    rows = pairs.withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("base"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("a", "b"))
    return rows.withColumn("nth", nth).join(sizes, "part").select("a", "b", (F.col("base") + F.col("nth")).alias("rank"))


def repeated_places(places: DataFrame, max_lines: int) -> DataFrame:
    """(key, content, pos, level, rank): rank of each suffix by its first 2^level lines, where these occur elsewhere too.

    Levels go up to the largest power of two in ``max_lines``.
    """
    ids = places.groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
    ranks = stored(_dense(ids.select(F.col("id").alias("a"), F.lit(0).alias("b")), -(1 << 63), (1 << 64) // RANGES), "line-ranks")
    level = stored(places.select(*PLACE, F.col("id").alias("a")).join(ranks.select("a", "rank"), "a").select(*PLACE, F.lit(0).alias("level"), "rank"), "suffixes")
    found, h = level, 1
    while 2 * h <= max_lines:
        later = level.select(*DOC, (F.col("pos") - h).alias("pos"), F.col("rank").alias("b"))
        pairs = stored(level.withColumnRenamed("rank", "a").join(later, PLACE), "suffix-pairs")
        distinct = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b")
        top = pairs.agg(F.max("a")).head()[0]
        if top is None:
            break
        ranks = stored(_dense(distinct, 1, -(-top // RANGES)), "line-ranks")
        level = stored(pairs.join(ranks, ["a", "b"]).select(*PLACE, (F.col("level") + 1).alias("level"), "rank"), "suffixes")
        found, h = found.unionAll(level), 2 * h
    return found


def later_copies(documents: DataFrame, min_chars: int = MIN_CHARS, whole_runs: bool = False) -> DataFrame:
    """(key, content, at): the lines that go, by document and number of the line in the text."""
    places = stored(line_places(documents, min_chars, whole_runs), "line-places")
    longest = places.agg(F.max(F.greatest("m", "back") if whole_runs else "m")).head()[0] or 0
    ranks = repeated_places(places.select(*PLACE, "id"), longest)
    starts = places.where("m is not null").select(*PLACE, "m")
    if whole_runs:
        starts = starts.unionAll(places.where("back is not null").select(*DOC, (F.col("pos") - F.col("back") + 1).cast("int"), "back")).distinct()
    starts = starts.select(*PLACE, F.col("m").cast("int").alias("m"), F.floor(F.log2("m") + 1e-9).cast("int").alias("level"))
    power = F.expr("shiftleft(1, level)")
    starts = starts.join(ranks.withColumnRenamed("rank", "head"), [*PLACE, "level"])
    ends = ranks.select(*DOC, F.col("pos").alias("end_pos"), "level", F.col("rank").alias("tail"))
    starts = starts.withColumn("end_pos", F.col("pos") + F.col("m") - power).join(ends, [*DOC, "end_pos", "level"])
    starts = stored(starts.select(*PLACE, "m", "head", "tail"), "run-starts")
    place = F.struct(*PLACE)
    firsts = starts.groupBy("m", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = starts.join(stored(firsts.drop("c"), "intervals"), ["m", "head", "tail"]).where(place != F.col("first"))
    gone = later.select(*DOC, F.explode(F.sequence("pos", F.col("pos") + F.col("m") - 1)).alias("pos")).distinct()
    return gone.join(places.select(*PLACE, "at"), PLACE).select(*DOC, "at")


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, whole_runs: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_deleted, text) of every row of ``documents`` (doc_id, text, anything else).

    Lines end at line feeds. Blank lines are in no run and stay. ``text`` joins the lines that stay, null stays
    null and counts no line. ``whole_runs`` deletes repeated runs to their last line. Rows that repeat doc_id and text are one document with one result for each of them;
    a null doc_id comes last in order.
    """
    gone = later_copies(documents, min_chars, whole_runs).groupBy(*DOC).agg(F.collect_set("at").alias("gone"))
    gone = stored(gone, "later-copies")
    small = (gone.agg(F.sum(F.size("gone") + 4)).head()[0] or 0) <= BROADCAST_NUMBERS
    rows = _keyed(documents).join(F.broadcast(gone) if small else gone, DOC, "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("gone", F.array().cast("array<int>"))), lambda i: lines[i]), "\n")
    return rows.select(
        F.nullif(F.col("key"), F.lit(NO_ID)).alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


SQL = f"""
WITH lines AS (
    SELECT doc_id, u.nr, u.line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d,
        LATERAL (SELECT unnest(range(len(d.parts))) AS nr, unnest(d.parts) AS line) u
), placed AS (
    SELECT doc_id, nr, line, row_number() OVER own AS pos, coalesce(sum(length(line)) OVER (own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(length(line)) OVER (PARTITION BY doc_id) AS total
    FROM lines WHERE line <> '' WINDOW own AS (PARTITION BY doc_id ORDER BY nr)
), starts AS (
    SELECT a.doc_id, a.pos, count(*) AS m, string_agg(b.line, chr(10) ORDER BY b.pos) AS run
    FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.before - a.before < {MIN_CHARS}
    WHERE a.total - a.before >= {MIN_CHARS} GROUP BY a.doc_id, a.pos
    UNION SELECT a.doc_id, min(b.pos), count(*), string_agg(b.line, chr(10) ORDER BY b.pos)
    FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.pos <= a.pos AND a.before + length(a.line) - b.before - length(b.line) < {MIN_CHARS}
    WHERE a.before + length(a.line) >= {MIN_CHARS} GROUP BY a.doc_id, a.pos
), marked AS (
    SELECT doc_id, pos, m, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM starts
), gone AS (
    SELECT DISTINCT p.doc_id, p.nr FROM marked s JOIN placed p ON p.doc_id = s.doc_id AND p.pos >= s.pos AND p.pos < s.pos + s.m WHERE s.nth > 1
), kept AS (
    SELECT l.doc_id, count(g.nr) AS n_deleted, string_agg(CASE WHEN g.nr IS NULL THEN l.line END, chr(10) ORDER BY l.nr) AS text
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.nr = l.nr GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted,
    CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
