"""Dependencies in source texts: routines, references, usages and statements to look at twice.

Texts are tokenised where they lie; what travels is distinct (unit, word) pairs. The functions ``..._in_lines``
give the same of source lines (owner, name, type, line, text) without putting a unit together: a row is a line,
ended or not, or several whole lines, in the order of type and line. Headers stand in one row. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_HEADER = r"(?im)^\s*((?:PROCEDURE|FUNCTION)\s+[A-Za-z][A-Za-z0-9_$#]*)"
_AGGREGATE = r"(?i)\b(SUM|COUNT|AVG)\s*\("


def _text(col: str = "source") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def without_line_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"--[^\n]*", " ")


def declared_routines(units: DataFrame) -> DataFrame:
    """(owner, name, position, routine, routine_kind): what a package's specification declares.

    The part before PACKAGE BODY counts; overloads are one routine, at their first place.
    """
    spec = F.regexp_replace(_text(), r"(?is)\bPACKAGE\s+BODY\b.*", "")
    headers = F.regexp_extract_all(spec, F.lit(_HEADER), F.lit(1))
    found = units.select("owner", "name", F.posexplode(headers).alias("pos", "header"))
    word = F.upper(F.regexp_extract("header", r"(?i)(?:PROCEDURE|FUNCTION)\s+(\S+)", 1))
    kind = F.upper(F.regexp_extract("header", r"(?i)(PROCEDURE|FUNCTION)", 1))
    return found.groupBy("owner", "name", word.alias("routine")).agg(
        F.min("pos").alias("position"), F.min_by(kind, "pos").alias("routine_kind")
    )


def routine_sections(units: DataFrame) -> DataFrame:
    """(owner, name, section, routine, body): the source cut in front of every routine header."""
    parts = F.split(_text(), r"(?im)(?=^[ \t]*(?:PROCEDURE|FUNCTION)\s+[A-Za-z])")
    cut = units.select("owner", "name", F.posexplode(parts).alias("section", "part"))
    header = r"(?i)^\s*(?:PROCEDURE|FUNCTION)\s+([A-Za-z][A-Za-z0-9_$#]*)"
    return cut.select(
        "owner", "name", "section", F.upper(F.regexp_extract("part", header, 1)).alias("routine"),
        F.regexp_replace("part", header, "").alias("body"),
    ).filter("routine <> ''")


LINES_PER_BLOCK = 10_000
"""Lines of a unit that are searched for their routine in one task."""
HOT_ROWS = 100_000
"""A word that stands in so many pairs is looked up by broadcast, for its rows would all meet in one task."""
_UNIT = ["owner", "name"]


def declared_routines_in_lines(lines: DataFrame) -> DataFrame:
    """(owner, name, position, routine, routine_kind) as ``declared_routines``; ``position`` is (type, line, place).

    Only lines with a header and the first line of each body leave their task.
    """
    body = r"(?i)\bPACKAGE\s+BODY\b"
    headers = F.regexp_extract_all(F.regexp_replace(_text("text"), r"(?is)\bPACKAGE\s+BODY\b.*", ""), F.lit(_HEADER), F.lit(1))
    found = lines.select(*_UNIT, "type", "line", F.posexplode(headers).alias("place", "header"))
    bodies = lines.filter(_text("text").rlike(body)).groupBy(*_UNIT).agg(F.min(F.struct("type", "line")).alias("body"))
    in_spec = F.coalesce(F.struct("type", "line") <= F.col("body"), F.lit(True))
    spec = found.join(bodies, _UNIT, "left").filter(in_spec)
    words = F.split(F.upper(F.trim("header")), r"\s+")
    spec = spec.select(*_UNIT, F.struct("type", "line", "place").alias("position"), words[1].alias("routine"), words[0].alias("kind"))
    first = spec.groupBy(*_UNIT, "routine").agg(F.min(F.struct("position", "kind")).alias("first"))
    return first.select(*_UNIT, "routine", "first.position", F.col("first.kind").alias("routine_kind"))


def routine_references_in_lines(lines: DataFrame, identifiers: DataFrame, *, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """(owner, name, routine, identifier) as ``routine_references``.

    Words meet the identifiers where the lines lie. A hit behind a header in its own row has its routine, and only its
    (unit, routine, identifier) goes on. For hits in rows without a header, headers of their units and these hits are put in
    order by blocks of lines: the last header before a hit is looked for in its block, and before its block among the
    blocks' last headers, so a unit of any length is many tasks. Whether there are such hits is asked while building.
    """
    header = r"(?i)^\s*(?:PROCEDURE|FUNCTION)\s+([A-Za-z][A-Za-z0-9_$#]*)"
    cut = F.split(_text("text"), r"(?im)(?=^[ \t]*(?:PROCEDURE|FUNCTION)\s+[A-Za-z])")
    parts = lines.select(*_UNIT, "type", "line", F.posexplode(cut).alias("place", "part"))
    at = F.struct("type", "line", "place").alias("at")
    routine = F.nullif(F.upper(F.regexp_extract("part", header, 1)), F.lit(""))
    block = F.floor(F.col("line") / lines_per_block).alias("block")
    parts = parts.select(*_UNIT, "type", block, at, routine.alias("routine"), F.regexp_replace("part", header, "").alias("body"))
    words = F.explode(_distinct_words(F.col("body"))).alias("word")
    wanted = _wanted(identifiers)
    own = parts.filter("routine is not null").select(*_UNIT, "routine", words).join(wanted, "word")
    own = own.select(*_UNIT, "routine", "identifier").distinct()
    unit_block = [*_UNIT, "type", "block"]
    loose = parts.filter("routine is null").select(*unit_block, "at", "routine", words).join(wanted, "word").drop("word")
    if loose.isEmpty():
        return own
    headers = parts.filter("routine is not null").select(*unit_block, "at", "routine", F.lit(None).cast("string").alias("identifier"))
    units = loose.select(*[F.col(c).alias(f"loose_{c}") for c in _UNIT]).distinct()
    same = F.col("owner").eqNullSafe(F.col("loose_owner")) & F.col("name").eqNullSafe(F.col("loose_name"))
    events = loose.unionByName(headers.join(units, same, "left_semi"))
    in_block = W.partitionBy(*unit_block).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    placed = events.withColumn("routine", F.last("routine", ignorenulls=True).over(in_block))
    hits = placed.filter("identifier is not null")
    # before the block: the last header of each block, carried along the blocks of the unit
    # (all columns of ``placed`` are used here as in the hits, so that both read one exchange)
    last = F.max(F.when(F.col("routine").isNotNull(), F.struct("at", "routine", "identifier")))
    ends = placed.groupBy(*unit_block).agg(last.alias("last"))
    along = W.partitionBy(*_UNIT).orderBy("type", "block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*unit_block, F.last("last.routine", ignorenulls=True).over(along).alias("carried"))
    found = hits.join(carried, unit_block, "left").withColumn("routine", F.coalesce("routine", "carried"))
    return found.filter("routine is not null").select(*_UNIT, "routine", "identifier").unionByName(own).distinct()


def usages_in_lines(lines: DataFrame, identifiers: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(identifier, owner, name) of units that mention an identifier, as ``usages``."""
    words = lines.select(*_UNIT, F.explode(_distinct_words(_text("text"))).alias("word"))
    found = words.join(_wanted(identifiers), "word").filter(F.lower("name") != F.col("word"))
    return _without_own(found, packages).select("identifier", *_UNIT).distinct()


def _without_own(found: DataFrame, packages: DataFrame | None) -> DataFrame:
    if packages is None:
        return found
    own = packages.select(F.lower("identifier").alias("word"), F.lower("package").alias("unit")).distinct()
    return found.withColumn("unit", F.lower("name")).join(own, ["word", "unit"], "left_anti")


def _wanted(identifiers: DataFrame) -> DataFrame:
    """(word, identifier): identifiers by their lower-case form, each form once."""
    return identifiers.groupBy(F.lower("identifier").alias("word")).agg(F.min("identifier").alias("identifier"))


def routine_references(units: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(owner, name, routine, identifier): routines whose own section mentions an identifier."""
    sections = routine_sections(units)
    words = sections.select("owner", "name", "routine", F.explode(_distinct_words(F.col("body"))).alias("word"))
    return words.join(_wanted(identifiers), "word").select("owner", "name", "routine", "identifier").distinct()


def _distinct_words(text: Column) -> Column:
    """Words as a word-boundary search would find them, and every run of words that $ or # join."""
    lower = F.lower(text)
    plain = F.regexp_extract_all(lower, F.lit(r"(?U)(\w+)"), F.lit(1))
    joined = F.regexp_extract_all(lower, F.lit(r"(?U)(\w+(?:[$#]+\w+)+)"), F.lit(1))

    def stretches(name: Column) -> Column:
        words, marks = F.split(name, "[$#]+"), F.split(name, r"(?U)\w+")
        ends = F.sequence(F.lit(1), F.size(words))

        def from_word(i: Column) -> Column:
            rest = F.filter(ends, lambda j: j > i)
            return F.transform(rest, lambda j: F.aggregate(
                F.sequence(i + 1, j), F.element_at(words, i), lambda name, k: F.concat(name, F.element_at(marks, k), F.element_at(words, k))
            ))

        return F.flatten(F.transform(ends, from_word))

    special = F.when(F.contains(lower, F.lit("$")) | F.contains(lower, F.lit("#")), F.flatten(F.transform(joined, stretches))).otherwise(F.array().cast("array<string>"))
    return F.array_union(plain, special)


def usages(units: DataFrame, identifiers: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(identifier, owner, name, kind): units that mention an identifier, itself excluded.

    ``packages`` (identifier, package) names the package a routine belongs to, which is no user of it.
    An inverted index: distinct words per unit meet the identifiers in one equi-join, whichever
    side is small. A word that is no identifier never leaves its task once the list is broadcast.
    """
    words = units.select("owner", "name", "kind", F.explode(_distinct_words(_text())).alias("word"))
    found = words.join(_wanted(identifiers), "word").filter(F.lower("name") != F.col("word"))
    return _without_own(found, packages).select("identifier", "owner", "name", "kind")


def referenced_tables(queries: DataFrame) -> DataFrame:
    """(query, table): bare upper-case names after FROM or JOIN in ``sql``."""
    name = r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_$#][\w$#]*(?:\.[A-Za-z_$#][\w$#]*)?)"
    names = F.array_distinct(F.transform(
        F.regexp_extract_all("sql", F.lit(name), F.lit(1)), lambda n: F.upper(F.substring_index(n, ".", -1))
    ))
    return queries.select("query", F.explode(names).alias("table"))


def aggregating(queries: DataFrame) -> DataFrame:
    """Queries with an aggregate that are not factored into WITH parts already."""
    return queries.filter(F.col("sql").rlike(_AGGREGATE) & ~F.col("sql").rlike(r"(?i)^\s*WITH\b"))


def unknown_references(scripts: DataFrame, known: DataFrame, programs: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(script, name): names of qualified references that no table, column, owner or program has.

    ``known`` and ``programs``: (name). A reference qualified by a program is a call, not a column.
    """
    # dealt out before equal rows are dropped: rows of a script hardly repeat, so counting them earlier would only hold them all
    return unresolved(scripts, known, programs, hot_rows=hot_rows).select("script", "name").repartition("script", "name").distinct()


def unresolved(scripts: DataFrame, known: DataFrame, programs: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(script, spread, name) of ``unknown_references`` as found, a row for each different pair in a script.

    Words of ``hot_rows`` pairs or more, at most one in as many pairs, are checked once each and the answer is broadcast.
    Their rows then go on under keys of their own, so no task gets all rows of a word.
    """
    pair = r"\b([A-Za-z][\w$#]*)\s*\.\s*([A-Za-z][\w$#]*)\b"
    text = without_line_comments(_text("code"))
    both = F.regexp_extract_all(text, F.lit(pair), F.lit(0))
    halves = F.array_distinct(F.transform(both, lambda p: F.upper(F.regexp_replace(p, r"\s", ""))))
    spread = F.concat(F.lit("\0"), F.xxhash64("script", "code").cast("string")).alias("spread")
    pairs = scripts.select("script", spread, F.explode(halves).alias("pair")).select(
        "script", "spread", F.substring_index("pair", ".", 1).alias("qualifier"), F.substring_index("pair", ".", -1).alias("name")
    )
    words = pairs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).alias("word")) for c in ("qualifier", "name")])))
    hot = words.groupBy("role", "word").count().filter(F.col("count") >= hot_rows)
    calls = programs.select(F.upper("name").alias("word")).distinct()
    names = known.select(F.upper("name").alias("word")).unionByName(calls).distinct()
    return _without(_without(pairs, "qualifier", calls, hot), "name", names, hot).drop("qualifier")


def _without(rows: DataFrame, role: str, listed: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows whose word in column ``role`` is not in ``listed`` (word); ``hot`` (role, word) are the frequent words."""
    own = hot.filter(F.col("role") == role).select("word")
    checked = own.join(listed.withColumn("is_listed", F.lit(True)), "word", "left")
    checked = checked.select(F.col("word").alias(role), F.coalesce("is_listed", F.lit(False)).alias("is_listed"))
    met = rows.join(F.broadcast(checked), role, "left").filter("is_listed is null or not is_listed")
    met = met.withColumn("word", F.when(F.col("is_listed").isNull(), F.col(role)).otherwise(F.col("spread")))
    return met.join(listed, "word", "left_anti").drop("word", "is_listed")


# Statements a reviewer should see, with what they do.
RISKY = (
    (r"(?is)\bDROP\s+(TABLE|VIEW|INDEX|SEQUENCE|PACKAGE|PROCEDURE|FUNCTION|TRIGGER|USER)\b", "drops an object"),
    (r"(?is)\bTRUNCATE\s+TABLE\b", "truncates a table"),
    (r"(?is)\bALTER\s+TABLE\b.*\bDROP\b", "drops a column or constraint"),
    (r"(?is)\bGRANT\b|\bREVOKE\b", "changes privileges"),
)


def risk_flags(code: Column) -> Column:
    """What a script does that should be read before it runs, line comments ignored."""
    text = without_line_comments(F.coalesce(code, F.lit("")))
    unscoped = text.rlike(r"(?i)\b(DELETE\s+FROM|UPDATE)\b") & ~text.rlike(r"(?i)\bWHERE\b")
    bare_body = text.rlike(r"(?i)^\s*(PROCEDURE|FUNCTION)\b") & ~text.rlike(r"(?im)^\s*CREATE\b")
    flags = [F.when(text.rlike(pattern), what) for pattern, what in RISKY]
    flags += [F.when(unscoped, "changes every row"), F.when(bare_body, "is only the body of a routine")]
    return F.array_compact(F.array(*flags))


def risky_scripts(scripts: DataFrame) -> DataFrame:
    """(script, risk) for every flag of every script."""
    return scripts.select("script", F.explode(risk_flags(F.col("code"))).alias("risk"))
