"""Which tables, documents or programs a question is about.

A text counts for the distinct words it shares with the question, each worth its rarity in the
corpus and weighted by the field it stands in. Only rows with a match leave the scan, as
(key, word, weight); the texts themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesense.functions.text import asked_words, asks_about_logs, content_words, question_words

# The weights of fields and boosts.
NAME, PURPOSE, COLUMN, MEANING = 10.0, 3.0, 2.0, 1.0
HISTORY, PROGRAM, LOG, NEIGHBOUR = 12.0, 6.0, 4.0, 2.0
MIN_DIRECT = PURPOSE


def word_hits(corpus: DataFrame, key: Sequence[str], fields: Mapping[str, float], words: Sequence[str]) -> DataFrame:
    """(key, word, weight): the question's words a row contains, with the weights of their fields summed."""
    if not words:
        return corpus.select(*key, F.lit("").alias("word"), F.lit(0.0).alias("weight")).limit(0)
    found = F.struct(
        *[asked_words(F.coalesce(F.col(c), F.lit("")), words).alias(f"f{i}") for i, c in enumerate(fields)]
    )

    def matches(held: Column) -> Column:
        def weighed(word: Column) -> Column:
            weights = [
                F.when(F.array_contains(held[f"f{i}"], word), w).otherwise(0.0) for i, w in enumerate(fields.values())
            ]
            return F.struct(word.alias("word"), sum(weights[1:], weights[0]).alias("weight"))

        asked = F.array(*[F.lit(w) for w in words])
        return F.filter(F.transform(asked, weighed), lambda m: m["weight"] > 0)

    # One evaluation per row: the words of a text are taken out once, then matched.
    per_row = F.flatten(F.transform(F.array(found), matches))
    return corpus.select(*key, F.inline(per_row))


def rarity(hits: DataFrame, total: Column) -> DataFrame:
    """(word, rarity): 1 for a word of a single row, falling towards 0 for common words."""
    seen = hits.groupBy("word").agg(F.count_if(F.col("weight") > 0).alias("n"))
    return seen.select("word", (F.log(1 + total / F.col("n")) / F.log(1 + total)).alias("rarity"))


def relevance(
    corpus: DataFrame, key: Sequence[str], fields: Mapping[str, float], question: str | Sequence[str]
) -> DataFrame:
    """(key, score) of the rows that share a word with the question."""
    words = question_words(question) if isinstance(question, str) else list(question)
    # Both uses below start from this one exchange of matches, so the corpus is scanned once.
    hits = word_hits(corpus, key, fields, words).repartition(*key)
    total = corpus.select(F.count(F.lit(1)).alias("n")).scalar()
    # One entry per word of the question.
    worth = rarity(hits, total).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "rarity"))).alias("worth")
    ).scalar()
    valued = F.coalesce(F.element_at(worth, F.col("word")), F.lit(1.0))
    return hits.groupBy(*key).agg(F.sum(F.col("weight") * valued).alias("score"))


def ranked(scores: DataFrame, limit: int, *, tie_break: Sequence[str]) -> DataFrame:
    return scores.orderBy(F.desc("score"), *tie_break).limit(limit)


# ------------------------------------------------------------------ the tables of an estate


def table_texts(tables: DataFrame, columns: DataFrame, meanings: DataFrame | None, purposes: DataFrame | None) -> DataFrame:
    """One row per table with its searchable fields: name, purpose, columns, meanings."""
    key = ["owner", "table"]
    names = columns.groupBy(*key).agg(F.array_join(F.collect_list("column"), " ").alias("columns_text"))
    texts = tables.select(*key, "comment").join(names, key, "left")
    empty = F.lit(None).cast("string")
    if meanings is not None:
        said = meanings.groupBy(*key).agg(F.array_join(F.collect_list("meaning"), " ").alias("meanings_text"))
        texts = texts.join(said, key, "left")
    else:
        texts = texts.withColumn("meanings_text", empty)
    texts = texts.join(purposes.select(*key, "purpose"), key, "left") if purposes is not None else texts.withColumn("purpose", empty)
    spaced = {c: F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")) for c in ("columns_text", "meanings_text")}
    return texts.withColumns({
        **spaced,
        "name_text": F.replace("table", F.lit("_"), F.lit(" ")),
        "purpose_text": F.concat_ws(" ", "purpose", "comment"),
    })


TABLE_FIELDS = {"name_text": NAME, "purpose_text": PURPOSE, "columns_text": COLUMN, "meanings_text": MEANING}


def boosted(scores: DataFrame, boosts: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """Add a constant to the tables named in each boost (owner, table)."""
    for i, (named, amount) in enumerate(boosts):
        flag = named.select("owner", "table").distinct().withColumn(f"b{i}", F.lit(float(amount)))
        scores = scores.join(flag, ["owner", "table"], "left")
        scores = scores.withColumn("score", F.col("score") + F.coalesce(f"b{i}", F.lit(0.0))).drop(f"b{i}")
    return scores


def tables_in_queries(query_log: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables a previous query names anywhere, word by word.

    A name of several owners is the first one's: by ``place`` where ``tables`` has it, else by name.
    """
    words = query_log.select(F.explode(F.regexp_extract_all(F.upper("sql"), F.lit(r"([A-Z_$#][\w$#]*)"))).alias("word"))
    order = ["place"] if "place" in tables.columns else []
    by_name = tables.groupBy(F.upper("table").alias("word")).agg(F.min(F.struct(*order, "owner", "table")).alias("t"))
    return words.distinct().join(by_name, "word").select("t.owner", "t.table")


def undirected(relationships: DataFrame) -> DataFrame:
    """(source, target) both ways, as owner.table, without self loops."""
    one, other = F.concat_ws(".", "owner", "table"), F.concat_ws(".", "parent_owner", "parent_table")
    ends = relationships.select(F.inline(F.array(
        F.struct(one.alias("source"), other.alias("target")), F.struct(other.alias("source"), one.alias("target"))
    )))
    return ends.filter("source <> target")


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) from edges given in both directions."""
    return edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, links): neighbours of the seeds (node) that are no seeds, with their number of links."""
    reached = edges.join(seeds.select(F.col("node").alias("source")).distinct(), "source", "left_semi")
    outside = reached.join(seeds.select(F.col("node").alias("target")), "target", "left_anti")
    return outside.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("links"))


def select_tables(scored: DataFrame, relationships: DataFrame, *, whole: bool = False, limit: int | None = None) -> DataFrame:
    """The tables worth showing: (owner, table, part), part being whole, direct, context or fallback.

    ``scored``: owner, table, place (catalog order), score for every table. Direct hits reach the
    floor and one join hop adds bridges; without any hit all tables stand in. With ``limit`` no part
    has more tables, the best first, bridges grow with the hits, and the most connected tables stand in.
    ``whole`` keeps the catalog as it is.
    """
    nodes = scored.withColumn("node", F.concat_ws(".", "owner", "table"))
    if whole:
        return nodes.select("owner", "table", F.lit("whole").alias("part"))
    any_hit = nodes.agg(F.coalesce(F.max("score") > 0, F.lit(False)).alias("h")).scalar()
    edges = undirected(relationships)

    def first(df: DataFrame, *order: Column | str) -> DataFrame:
        return df if limit is None else df.orderBy(*order).limit(limit)

    direct = first(nodes.filter(F.col("score") >= MIN_DIRECT), F.desc("score"), "place")
    context = nodes.join(one_hop(edges, direct.select("node")), "node")
    if limit is not None:
        n_direct = direct.agg(F.count(F.lit(1)).alias("n")).scalar()
        soft = F.least(F.lit(limit), F.greatest(F.lit(6), 2 * n_direct + 2))
        order = [F.desc("links"), F.desc("score"), F.asc("place")]
        context = first(context, *order).withColumn("nth", F.row_number().over(W.orderBy(*order))).filter(F.col("nth") <= soft - n_direct)

    connected = nodes.join(degree(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    fallback = first(connected, F.desc("degree"), "place")

    def part(df: DataFrame, name: str, condition: Column) -> DataFrame:
        return df.filter(condition).select("owner", "table", F.lit(name).alias("part"))

    return (
        part(direct, "direct", any_hit)
        .unionByName(part(context, "context", any_hit))
        .unionByName(part(fallback, "fallback", ~any_hit))
    )


def omitted(tables: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was left out, in catalog order where ``tables`` has a ``place``, and how many there are."""
    left = tables.join(kept, ["owner", "table"], "left_anti")
    order = ["place"] if "place" in tables.columns else ["owner", "table"]
    return left.orderBy(*order), left.agg(F.count(F.lit(1)).alias("omitted"))


def select_logs(logs: DataFrame, kept: DataFrame, question: str) -> DataFrame:
    """Log tables to keep: all for a question about errors, else those of kept tables."""
    if not asks_about_logs(question_words(question)):
        logs = logs.join(kept, ["owner", "table"], "left_semi")
    return logs.orderBy(*(["place"] if "place" in logs.columns else ["owner", "table"]))


def program_scores(programs: DataFrame, kept: DataFrame, question: str) -> DataFrame:
    """Programs by what the question says and by the kept tables they use.

    ``programs``: owner, name, routines, summary, tables_used (arrays of names). A name counts per
    word, routines once, a summary per word, and every kept table a little.
    """
    words = F.array(*[F.lit(w) for w in question_words(question)]).cast("array<string>")

    def shared(text: Column) -> Column:
        spaced = F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" "))
        return F.size(F.array_intersect(content_words(spaced), words))

    used = programs.select(
        "owner", "name", F.explode(F.transform("tables_used", lambda t: F.upper(F.substring_index(t, ".", -1)))).alias("t")
    )
    linked = used.join(kept.select(F.upper("table").alias("t")).distinct(), "t", "left_semi")
    links = linked.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("links"))
    routine = F.when(shared(F.array_join("routines", " ")) > 0, NAME).otherwise(0.0)
    score = NAME * shared(F.col("name")) + routine + PURPOSE * shared(F.col("summary"))
    scored = programs.withColumn("score", score).join(links, ["owner", "name"], "left")
    total = F.col("score") + NEIGHBOUR * F.coalesce("links", F.lit(0))
    return scored.select("owner", "name", total.alias("score"))


def programs_named(programs: DataFrame, question: str) -> DataFrame:
    """Tables used by programs the question names, by program or routine name: (table)."""
    words = F.array(*[F.lit(w) for w in question_words(question)]).cast("array<string>")
    names = F.replace(F.concat_ws(" ", "name", F.array_join("routines", " ")), F.lit("_"), F.lit(" "))
    named = programs.filter(F.arrays_overlap(content_words(names), words))
    return named.select(F.explode("tables_used").alias("t")).select(F.substring_index("t", ".", -1).alias("table")).distinct()


def select_programs(scores: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Programs by score, the best first; all of them unless a limit is given."""
    order = [F.desc("score"), F.asc("owner"), F.asc("name")]
    return scores.orderBy(*order) if limit is None else scores.orderBy(*order).limit(limit)


def corpus_rarity(corpus: DataFrame, text: str) -> DataFrame:
    """(word, rows, rarity) for every word of a corpus; a row sends each of its words once."""
    total = corpus.select(F.count(F.lit(1)).alias("n")).scalar()
    words = corpus.select(F.explode(content_words(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    seen = words.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    return seen.select("word", "rows", (F.log(1 + total / F.col("rows")) / F.log(1 + total)).alias("rarity"))


def first_seen(rows: DataFrame, name: str, ordinal: str) -> DataFrame:
    """(name, place): distinct names in the order in which they first appear."""
    first = rows.groupBy(name).agg(F.min(ordinal).alias("first"))
    return first.select(name, F.row_number().over(W.orderBy("first", name)).alias("place"))
