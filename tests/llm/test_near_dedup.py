"""Near-duplicates against all pairs by brute force."""

import random
import re

import pytest

from tablesense.llm import near_dedup

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return {d: (len(s), rows[root(i)][0]) for i, (d, s) in enumerate(zip([r[0] for r in rows], sets, strict=True))}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = ["", None, "  \n", "one", "One", "two words", "a b c", "a b c d", "A b\tc d"]
    base = text(120)
    for _ in range(90):  # near copies with few and with many changes: some link only through others
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 7))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    passage = text(70)
    rows += [" ".join(text(30) + passage + text(20)) for _ in range(50)]  # share a passage of over half
    rows += [" ".join(text(rng.randrange(1, 60))) for _ in range(30)]
    rows += [" ".join(base)] * 5
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("words", [4, 5])
def test_components_equal_brute_force(make, monkeypatch, words):
    monkeypatch.setattr(near_dedup, "CROWD", 8)
    rows = corpus(words)
    found = near_dedup.near_duplicates(make(rows, "doc_id long, text string"), words, 80).collect()
    want = brute(rows, words, 80)
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_odd_rows(make):
    text = "some words that make a text of its own"
    rows = [(3, text, 1), (3, text, 2), (None, text, 3), (None, "alone and without an id at all", 4), (5, None, 5), (6, "", 6)]
    documents = make(rows, "doc_id long, text string, n long")
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(documents).collect()}
    assert found == {(3, 3, True), (None, 3, False), (None, None, True), (5, 5, True), (6, 6, True)}
    kept = near_dedup.deduplicated(documents)
    assert kept.columns == documents.columns and 4 <= kept.count() <= 5
    assert near_dedup.near_duplicates(documents.limit(0)).count() == 0


def test_texts_without_an_id_or_under_one_id(make):
    rng = random.Random(7)
    text = lambda: [f"w{rng.randrange(10_000)}" for _ in range(60)]
    base, alone, given, under = text(), text(), text(), text()
    near = lambda w: [*w[:30], "changed", *w[31:]]
    rows = [(None, base), (None, near(base)), (None, alone), (5, given), (None, near(given)), (9, under), (9, near(given)), (9, under)]
    documents = make([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(documents).collect()}
    assert found == {(None, None, True), (5, 5, True), (None, 5, False), (9, 9, True), (9, 5, False)}
    kept = [(r["doc_id"], r["text"].split()) for r in near_dedup.deduplicated(documents).collect()]
    assert len(kept) == 4 and sum(k in ((None, base), (None, near(base))) for k in kept) == 1
    assert all(k in kept for k in ((None, alone), (5, given), (9, under)))


def test_hub_pairs_stay_below_the_members_of_the_lists(make):
    """Texts in many lists with a large component meet its members dealt over the lists, not all of them in each list."""
    rows = [(value, key, 10, 100) for value in range(20) for key in range(60)]
    made = []

    def verify(pairs):
        made.append(pairs.count())
        return pairs.where("a < 30 and b < 30 or a >= 30 and b = a + 1 or a < 30 and b = 59")

    labels, crowded = near_dedup._resolve(make(rows, "value long, key long, n long, room long"), verify, None, 80, 32)
    assert crowded is None or not crowded.count()
    assert {r["component"] for r in labels.collect()} == {0} and labels.count() == 60
    assert len(made) >= 2 and made[1] <= 20 * 30


def test_a_text_in_one_list_meets_several_hubs(make):
    rows = [(1, key, 10, 100, 0 if key < 40 else key, 0, 2) for key in range(42)] + [(2, 41, 10, 3, 41, 0, 1), (2, 5, 10, 100, 0, 0, 1)]
    open_ = make(rows, "value long, key long, n long, room long, component long, main long, outside long")
    pairs = [(r["a"], r["b"]) for r in near_dedup._hub_pairs(open_, 80).collect()]
    assert all(a < 40 for a, _ in pairs) and len(set(pairs)) == len(pairs)
    met = [sum(b == key for _, b in pairs) for key in (40, 41)]  # a room of 3 rules the second list out
    assert 4 < met[0] <= near_dedup.HUBS and met[1] == 4


def variants(count, seed):
    """Texts of 150 words with a few changed ones each; half of the new words occur in several texts."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(count):
        w = list(base)
        for _ in range(min(12, int(rng.expovariate(0.25)))):
            w[rng.randrange(150)] = f"c{rng.randrange(40)}" if rng.random() < 0.5 else f"own{rng.random()}"
        rows.append((i, " ".join(w)))
    return rows


def test_variants_of_one_text_make_pairs_in_proportion_to_their_number(make, monkeypatch):
    """A third of the variants is linked with nothing; they are not compared with all the others."""
    rows, made, linked = variants(700, 5), [], near_dedup.linked

    def counted(pairs, *rest):
        made.append(pairs.distinct().count())
        return linked(pairs, *rest)

    monkeypatch.setattr(near_dedup, "linked", counted)
    monkeypatch.setattr(near_dedup, "CROWD", 8)
    found = near_dedup.near_duplicates(make(rows, "doc_id long, text string"), 5, 80).collect()
    want = brute(rows, 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert 100 < sum(d == c for d, (_, c) in want.items()) < 600
    assert sum(made) < 12 * len(rows)


@pytest.mark.parametrize("percent", [60, 80])
def test_common_differences_find_every_link(make, percent):
    """Sets around one or two majorities, some without: each link between components is sure or among the pairs."""
    rng = random.Random(percent)
    majority = {g: set(range(1000 * g, 1000 * g + 40)) for g in (0, 1)}
    sets = [set(rng.sample(range(60), rng.randrange(1, 30))) for _ in range(20)]
    for _ in range(140):
        s = set(rng.sample(sorted(majority[rng.random() < 0.3]), rng.randrange(28, 41)))
        sets.append(s | {rng.randrange(2000, 2030) for _ in range(rng.randrange(12))})
    sets = [set(s) for s in {frozenset(s) for s in sets}]
    ids = range(len(sets))
    links = {(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    told = make([(k, len(s), sorted(s)) for k, s in enumerate(sets)], "key long, n long, sketch array<long>")
    groups = {7: ids, 8: ids[: len(ids) // 2]}
    crowded = make([(v, k, g) for g, keys in groups.items() for k in keys for v in (1, 2)], "value long, key long, main long")
    apart = near_dedup._differences(crowded, told, percent)
    sure = {(r["a"], r["key"]) for r in apart.where("slack + top >= 0 and key <> a").collect()}
    assert all((min(x), max(x)) in links for x in sure)
    own = make([(k, k) for k in ids], "key long, component long")
    pairs = {(r["a"], r["b"]) for r in near_dedup._difference_pairs(apart, own, percent).collect()}
    pairs = {x for x in pairs if (min(x), max(x)) in links} | sure
    found = near_dedup.relabelled(own, make(sorted(pairs), "a long, b long"))
    root = list(ids)
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["key"]: r["component"] for r in found.collect()} == dict(enumerate(root))
