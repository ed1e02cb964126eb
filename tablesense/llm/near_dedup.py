"""Near-duplicate documents by bottom-k sketches of one hash function, verified by exact Jaccard similarity.

1. Every text becomes its set of word shingles, hashed to 63 bits; the ``k`` smallest values are its sketch.
2. Equal sets form a class with a number of its own and one representative row, so thousands of exact copies cost one
   row. All later steps go by the class, since a doc_id may be null or repeated over different texts.
3. Inverted lists of the retained values propose pairs. Within a sketch, values go from rare to common, and
   only the first ones are listed, so many that two texts over the threshold must meet in one: sketches of
   whole sets must share as many values as the threshold says, cut sketches share ``share`` of theirs except
   with a probability below 1e-6. Common passages thus rarely open a list.
4. Pairs whose sizes allow the threshold are estimated from the sketch of their union and, if near it,
   verified on their full sets.
5. A list first compares its members with one of them. Components are formed, and only lists that still hold
   several go on: members outside the largest component meet a few members of it, dealt over the lists they share
   so that no list makes more pairs than it has members, and those still outside meet all members of other
   components. So a group of m near copies costs about m comparisons a list, and no link
   between different components is lost. Lists with many members outside (texts that share a passage of about
   half their length) are replaced by lists of the rarest shingles of their members' full sets, where such
   texts do not meet.
6. Lists of full sets with many members outside hold variants of one text. Each member is described by what it
   has other than the shingles of the majority. The one closest to the majority links all it must be linked with
   whatever they differ in; every other link needs common differences, so only members that meet in lists of their
   rarest differences are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.common import LOWER, SPACE, joined, map_batches, mix, pieces, prefix_hash, runs, sliced, span_hashes, stored

SKETCH = 48
SHARE = 0.45
SALTS = 64
CROWD = 32
"""Lists with more members outside their largest component are listed anew by full sets."""
HUBS = 8
"""Members of the largest component that the others are compared with first, over all their lists together."""
FEW = 8
"""Members outside the largest component that a list of full sets compares with all; with more, differences decide."""
BROADCAST_KEYS = 1_000_000
NO_ID = (1 << 63) - 1


def shingle_sets(texts: list[str | None], words: int):
    """The sorted distinct 63-bit shingle hashes of each text, in order; null and wordless texts have none."""
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for _, group in pieces(texts):
        data, starts = joined(group)
        data = LOWER[data]
        word_start, word_end = runs(~SPACE[data])
        h = span_hashes(prefix_hash(data), word_start, word_end)
        first = np.append(np.searchsorted(word_start, starts), len(h))
        full = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            full += h[k : k + len(full)] * factors[k]
        full = mix(full) >> np.uint64(1)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                yield np.unique(full[a : b - words + 1])
            elif b > a:
                short = (h[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64)) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def sketches(keyed: DataFrame, words: int, k: int) -> DataFrame:
    """(key, content, n, d1, d2, sketch) of every row of (key, content, text): size and digest of the set, its k smallest values."""

    def run(batches):
        for batch in sliced(batches):
            n, d1, d2, low = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                n.append(len(s))
                d1.append(int(s.sum(dtype=np.uint64) >> np.uint64(1)))
                d2.append(int(np.bitwise_xor.reduce(mix(s), initial=0) >> np.uint64(1)) if len(s) else 0)
                low.append(s[:k])
            columns = [batch.column("key"), batch.column("content"), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), _lists(low)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "content", "n", "d1", "d2", "sketch"])

    return map_batches(keyed, run, "key long, content long, n long, d1 long, d2 long, sketch array<long>")


def full_sets(keyed: DataFrame, words: int) -> DataFrame:
    """(key, items): the whole shingle set of each row of (key, text)."""

    def run(batches):
        for batch in sliced(batches, 256):
            arrays = [batch.column("key"), _lists(list(shingle_sets(batch.column("text").to_pylist(), words)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "items"])

    return map_batches(keyed, run, "key long, items array<long>")


def listed(representatives: DataFrame, k: int | None, percent: int) -> DataFrame:
    """(value, key, n, room): the inverted lists, each sketch entered under its rarest values only.

    Without ``k`` the sketches are whole sets. ``room`` is how many values of the set come after this one; two
    texts that meet here first share at most one more than the smaller room.
    """
    values = representatives.select("key", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    counts = stored(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "sketch-values")
    held = F.ceil(F.col("m") * percent / 100)
    if k:
        held = F.when(F.col("n") * 100 <= k * percent, held).otherwise(F.floor(F.col("m") * SHARE))
    shared = values.join(counts, "value").groupBy("key", "n", "m").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    single = F.col("m") - F.size("shared")
    kept = F.slice("shared", F.lit(1), F.greatest(F.col("m") - held + 1 - single, F.lit(0)).cast("int"))
    rows = shared.select("key", "n", single.alias("single"), F.posexplode(kept).alias("pos", "x"))
    room = F.col("n") if k else F.col("n") - F.col("single") - F.col("pos") - 1
    return rows.select(F.col("x.value").alias("value"), "key", "n", room.alias("room"))


def class_texts(keyed: DataFrame, reps: DataFrame, keys: DataFrame, repeated: bool) -> DataFrame:
    """(key, text): a text of each class in ``keys``; ``repeated`` tells whether several rows may have a class's doc_id and text."""
    wanted = reps.select("key", "doc", "content").join(keys, "key", "left_semi").withColumnsRenamed({"key": "class", "doc": "key"})
    small = keys.count() <= BROADCAST_KEYS
    found = keyed.join(F.broadcast(wanted) if small else wanted, ["key", "content"]).select(F.col("class").alias("key"), "text")
    return found.dropDuplicates(["key"]) if repeated else found


def linked(pairs: DataFrame, representatives: DataFrame, texts, words: int, k: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets reach the threshold: estimate on the union's sketch, then exact.

    ``texts`` gives (key, text) for a frame of keys.
    """
    pairs = pairs.distinct()
    low = representatives.select("key", "sketch")
    both = pairs.join(low.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), "a")
    both = both.join(low.select(F.col("key").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    likely = stored(both.where(shared >= SHARE * F.size(union)).select("a", "b"), "likely-pairs")
    if not likely.limit(1).count():
        return likely
    keys = stored(likely.select(F.col("a").alias("key")).unionAll(likely.select("b")).distinct(), "likely-keys")
    sets = stored(full_sets(texts(keys), words), "likely-sets")
    salted = likely.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = salted.join(sets.select(F.col("key").alias("b"), F.col("items").alias("ib")), "b")
    right = salted.select("a", "salt").distinct().join(sets.select(F.col("key").alias("a"), F.col("items").alias("ia")), "a")
    inter = F.size(F.array_intersect("ia", "ib"))
    met = left.join(right, ["a", "salt"]).select("a", "b", inter.alias("i"), (F.size("ia") + F.size("ib") - inter).alias("u"))
    return met.where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(key, component): the smallest key reachable, for every key in the stored ``edges`` (a, b).

    Smallest label among neighbours, then the label of the label, until nothing changes; each step is stored.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stored(both.groupBy(F.col("a").alias("key")).agg(F.least(F.col("key"), F.min("b")).alias("component")), "labels")
    while True:
        told = both.join(label.withColumnRenamed("key", "a"), "a").select(F.col("b").alias("key"), "component", F.lit(False).alias("own"))
        told = told.unionAll(label.select("key", "component", F.lit(True)))
        near = told.groupBy("key").agg(F.min("component").alias("near"), F.max(F.when(F.col("own"), F.col("component"))).alias("component"))
        jump = label.select(F.col("key").alias("near"), F.col("component").alias("next"))
        step = stored(near.join(jump, "near").select("key", "next", "component"), "labels")
        changed = step.where("next < component").limit(1).count()
        label = step.select("key", F.col("next").alias("component"))
        if not changed:
            return label


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (key, component) after further links (a, b); only links between components are followed."""
    between = links
    for end in ("a", "b"):
        own = labels.select(F.col("key").alias(end), F.col("component").alias(f"of_{end}"))
        between = between.join(own, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    between = stored(between.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "label-links")
    if not between.limit(1).count():
        return labels
    roots = components(between)
    moved = labels.join(roots.select(F.col("key").alias("component"), F.col("component").alias("root")), "component", "left")
    moved = moved.select("key", F.coalesce("root", "component").alias("component"))
    # a key without a label so far is a root's key only
    return stored(moved.unionAll(roots).groupBy("key").agg(F.min("component").alias("component")), "labels")


def _fits(percent: int, n: str | Column = "n_a", room: str | Column = "room_a") -> Column:
    """Whether sizes and rooms of the two sides of a pair allow the similarity; the second side is given."""
    n = F.col(n) if isinstance(n, str) else n
    return (F.least("room", room) + 1) * (100 + percent) >= (F.col("n") + n) * percent


def _as_a() -> list[Column]:
    return [F.col(f"x.{c}").alias(name) for c, name in (("key", "a"), ("n", "n_a"), ("room", "room_a"))]


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(value, key, n, room, component, main, outside) of lists that still hold several components.

    ``main`` is the largest component, ``outside`` counts the members beyond it. The list's first pivot has been
    compared with all and is left out.
    """
    members = lists.where("m > 2 and key <> a").join(labels, "key", "left")
    members = members.select("value", "key", "n", "room", F.coalesce("component", "key").alias("component"))
    parts = members.groupBy("value", "component").agg(F.count("*").alias("c"))
    several = parts.groupBy("value").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("parts"))
    several = several.where("parts > 1").select("value", F.col("top.component").alias("main"), (F.col("c") - F.col("top.c")).alias("outside"))
    return stored(members.join(several, "value"), "open-members")


def _hub_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """(a, b): members outside the largest component with a few of that component whose sizes allow the similarity.

    A member of many open lists takes one from each, a member of few lists several, so the pairs are at most
    the members of the lists and ``HUBS`` for each text. Which ones it takes follows from a hash.
    """
    member = F.struct("key", "n", "room")
    hubs = open_.where("component = main").groupBy("value", F.pmod(F.xxhash64("key"), F.lit(HUBS)).alias("part"))
    hubs = hubs.agg(F.min(member).alias("x")).groupBy("value").agg(F.sort_array(F.collect_list("x")).alias("hubs"))
    each = F.ceil(F.lit(HUBS) / F.count("*").over(Window.partitionBy("key"))).cast("int")
    outside = open_.where("component <> main").select("value", "key", "n", "room", each.alias("each"))
    fitting = F.filter("hubs", lambda x: _fits(percent, x["n"], x["room"]))
    met = outside.join(hubs, "value").select("value", "key", "each", fitting.alias("x")).where(F.size("x") > 0)
    first = F.pmod(F.xxhash64("value", "key"), F.size("x")).cast("int") + 1
    met = met.select("key", F.explode(F.slice(F.concat("x", "x"), first, F.least(F.size("x"), "each"))).alias("x"))
    return met.select(F.col("x.key").alias("a"), F.col("key").alias("b"))


def _differences(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(g, key, diff, slack, a, top) of every member of open lists: where its set differs from the majority of its group.

    A group ``g`` is all lists with one largest component. Two sets are linked if and only if their slacks and
    2 * (100 + percent) for each common difference add up to 0 or more. ``a`` is the member with the largest slack, ``top``.
    """
    members = crowded.select(F.col("main").alias("g"), "key").distinct()
    members = stored(members.join(sets.select("key", "n", F.col("sketch").alias("items")), "key"), "group-members")
    sizes = members.groupBy("g").agg(F.count("*").alias("size"))
    held = members.select("g", F.explode("items").alias("value")).groupBy("g", "value").agg(F.count("*").alias("c"))
    most = held.join(sizes, "g").where(F.col("c") * 2 > F.col("size")).groupBy("g").agg(F.collect_list("value").alias("most"))
    # without a value that most members hold, the whole set is the difference
    most = sizes.select("g").join(most, "g", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    most = most.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(most, ["g", "salt"])
    met = met.select("g", "key", "n", F.concat(F.array_except("items", "most"), F.array_except("most", "items")).alias("diff"))
    slack = F.col("n") * (100 - percent) - F.size("diff") * (100 + percent)
    met = stored(met.select("g", "key", "diff", slack.cast("long").alias("slack")), "differences")
    top = met.groupBy("g").agg(F.max(F.struct("slack", "key")).alias("x"))
    return met.join(top.select("g", F.col("x.slack").alias("top"), F.col("x.key").alias("a")), "g")


def _difference_pairs(apart: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of different components that may have as many differences in common as a link needs.

    All members with a slack of -top or more are linked with the member closest to the majority, so one side of a
    pair has less. Of that follows how many common differences a member needs at least; as in ``listed``,
    it is entered under its rarest ones only, so many that it must meet its partners there.
    """
    each = 2 * (100 + percent)
    partner = F.when(F.col("slack") + F.col("top") < 0, F.col("top")).otherwise(-F.col("top") - 1)
    need = F.greatest(F.ceil((-F.col("slack") - partner) / each), F.lit(1))
    root = labels.select(F.col("key").alias("a"), F.col("component").alias("root"))
    members = apart.join(labels, "key", "left").join(root, "a", "left").withColumn("root", F.coalesce("root", "a"))
    component = F.when(F.col("slack") + F.col("top") >= 0, F.col("root")).otherwise(F.coalesce("component", "key"))
    own = ["g", "key", "slack", "component", "root", "need"]
    values = members.withColumn("component", component).withColumn("need", need).select(*own, F.explode("diff").alias("value"))
    counts = values.groupBy("g", "value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(counts, ["g", "value"]).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    kept = F.slice("shared", F.lit(1), F.greatest(F.size("shared") - F.col("need") + 1, F.lit(0)).cast("int"))
    rows = shared.select(*own, F.size("shared").alias("held"), F.posexplode(kept).alias("pos", "x"))
    rows = rows.select(*own[:-1], F.col("x.value").alias("value"), (F.col("held") - F.col("pos")).alias("left"))
    rows = stored(rows, "difference-lists")
    outside = rows.where("component <> root").drop("root").withColumnsRenamed({c: f"{c}_a" for c in ("key", "component", "slack", "left")})
    met = rows.join(outside, ["g", "value"]).where("component <> component_a and (component = root or key > key_a)")
    met = met.where(F.col("slack") + F.col("slack_a") + F.least("left", "left_a") * each >= 0)
    return met.select(F.col("key_a").alias("a"), F.col("key").alias("b"))


def _resolve(lists: DataFrame, verify, labels: DataFrame | None, percent: int, crowd: int, sets: DataFrame | None = None):
    """The components after all links between different components within the lists: (labels, keys of crowded lists or None).

    First each list's smallest key is compared with all members, then a few of the largest component with those
    outside it, and last everyone outside it with everyone of another component. Lists with more than ``crowd``
    members outside take no part in that last step: with ``sets``, the whole sets of the members, they are resolved
    by differences, without they are left to the caller. Steps without an open list are left out.
    """
    member = F.struct("key", "n", "room")
    pivots = lists.groupBy("value").agg(F.min(member).alias("x"), F.count("*").alias("m")).where("m > 1").select("value", "m", *_as_a())
    lists = stored(lists.join(pivots, "value"), "lists")
    links = stored(verify(lists.where((F.col("key") != F.col("a")) & _fits(percent)).select("a", F.col("key").alias("b"))), "links")
    labels = components(links) if labels is None else relabelled(labels, links)
    open_ = _open(lists, labels)
    if not open_.limit(1).count():
        return labels, None
    pairs = _hub_pairs(open_, percent)
    labels = relabelled(labels, stored(verify(pairs), "links"))
    open_ = _open(lists, labels)
    if not open_.limit(1).count():
        return labels, None
    few = open_.where(F.col("outside") <= crowd)
    outside = few.where("component <> main").select("value", member.alias("x"), F.col("component").alias("component_a"))
    pairs = few.join(outside.select("value", "component_a", *_as_a()), "value").where((F.col("component") != F.col("component_a")) & _fits(percent))
    pairs = pairs.where("component = main or key > a").select("a", F.col("key").alias("b"))
    left = open_.where(F.col("outside") > crowd)
    if sets is None or not left.limit(1).count():
        labels = relabelled(labels, stored(verify(pairs), "links"))
        return labels, left.select("key").distinct() if sets is None else None
    apart = _differences(left, sets, percent)
    sure = apart.where("slack + top >= 0 and key <> a").select("a", F.col("key").alias("b"))
    links = verify(pairs.unionAll(_difference_pairs(apart, labels, percent))).unionAll(sure)
    return relabelled(labels, stored(links, "links")), None


def _grouped(documents: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    """(key, content, n, first): for every row of ``documents``, the smallest (key, content) of its component.

    ``key`` is doc_id, null as the largest number, and ``content`` a hash of the text.
    """
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("content"), "text")
    rows = stored(sketches(keyed, words, k), "sketches")
    own = F.struct("key", "content")
    classes = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(own).alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    told = classes.select("class", F.col("rep.key").alias("key"), F.col("rep.content").alias("content"), "d1", "d2", "n")
    reps = rows.join(told, ["key", "content", "d1", "d2", "n"])
    reps = reps.select(F.col("class").alias("key"), "n", "sketch", F.col("key").alias("doc"), "content").dropDuplicates(["key"])
    reps = stored(reps, "representatives")
    repeated = bool(rows.groupBy("key", "content").count().where("count > 1").limit(1).count())
    texts = keyed.where("text is not null")

    def text_of(keys: DataFrame) -> DataFrame:
        return class_texts(texts, reps, keys, repeated)

    def verify(pairs: DataFrame) -> DataFrame:
        return linked(pairs, reps.select("key", "n", "sketch"), text_of, words, k, percent)

    labels, crowded = _resolve(listed(reps.select("key", "n", "sketch"), k, percent), verify, None, percent, CROWD)
    crowded = crowded if crowded is None else stored(crowded, "crowded")
    if crowded is not None and crowded.limit(1).count():
        whole = full_sets(text_of(crowded), words).select("key", F.size("items").alias("n"), F.col("items").alias("sketch"))
        whole = stored(whole, "crowded-sets")
        labels, _ = _resolve(listed(whole, None, percent), verify, labels, percent, FEW, whole)
    labels = labels.withColumnRenamed("key", "class")
    linked_ = classes.select("class", "rep").join(labels, "class")
    firsts = linked_.groupBy("component").agg(F.min("rep").alias("first"))
    firsts = linked_.join(firsts, "component").select("class", "first")
    moved = classes.join(firsts, "class", "left").where("copies > 1 or first < rep")
    moved = stored(moved.select("d1", "d2", "n", F.coalesce("first", "rep").alias("first")), "moved")
    found = rows.select("key", "content", "n", "d1", "d2").join(moved, ["d1", "d2", "n"], "left")
    return found.select("key", "content", "n", F.coalesce("first", own).alias("first"))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``documents`` (doc_id, text, anything else).

    Two texts are linked when their sets of ``words``-word shingles (A-Z lowered, words split at ASCII white
    space; fewer words make one shingle) have a Jaccard similarity of ``percent`` / 100 or more. The component
    is the smallest doc_id reachable; ``kept`` marks it. Rows without words are alone. Repeated rows form one
    component. A null doc_id counts as the largest id: it is named only where no other id is in its component.
    """
    found = _grouped(documents, words, percent, k)
    doc_id, component = F.nullif(F.col("key"), F.lit(NO_ID)), F.nullif(F.col("first.key"), F.lit(NO_ID))
    return found.select(
        doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), doc_id.eqNullSafe(component).alias("kept")
    )


def deduplicated(documents: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """One row of ``documents`` for each component, columns as they are: that of the smallest doc_id.

    Rows are told apart by doc_id and text, so texts that share an id, or have none, are decided one by one. Of
    rows that repeat both, one stays.
    """
    names = ["_near_key", "_near_content"]
    keyed = documents.withColumn(names[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(names[1], F.xxhash64("text"))
    found = _grouped(documents, words, percent, k).withColumnsRenamed({"key": names[0], "content": names[1]})
    found = found.groupBy(*names).agg(F.min(F.struct(*names) == F.col("first")).alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    found = stored(found, "near-kept")
    gone, several = found.where("not kept").select(*names), found.where("kept").select(*names)
    small = gone.count() <= BROADCAST_KEYS
    rows = keyed.join(F.broadcast(gone) if small else gone, names, "left_anti")
    if several.limit(1).count():
        once = rows.join(several, names, "left_anti")
        rows = once.unionByName(rows.join(several, names, "left_semi").dropDuplicates(names))
    return rows.select(documents.columns)
