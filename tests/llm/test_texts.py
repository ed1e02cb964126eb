"""Fingerprints, line runs, benchmark passages, pages and lists on small cases and against brute force."""

import datetime as dt
import hashlib
import random
import time

import pytest

from tablesense.llm import decontamination, fingerprints, html_extraction, line_dedup, url_filters


def test_fingerprints_of_neighbours(make):
    rng = random.Random(1)
    rows = [(i, " ".join(str(rng.random()) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "ä" * 40_000), (503, "same"), (504, "same")]
    documents = make([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(7)
    found = {r["doc_id"]: r for r in fingerprints.with_next(documents).collect()}
    texts = [t or "" for _, t in rows]
    assert len(found) == len(rows)
    for (i, _), text, after in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        want = text[: len(text) - half] + after[:half]
        r = found[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(text) and r["edited_fingerprint"] == fingerprints.fingerprint(want)
        assert r["near_next"] == fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(after))
    assert found[503]["near_next"] == 1.0
    assert fingerprints.with_next(documents.limit(0)).count() == 0
    one = fingerprints.with_next(make([(None, "abc"), (None, "abc")], "doc_id long, text string")).collect()
    assert len(one) == 2 and one[0]["near_next"] == 1.0 and one[0]["doc_id"] is None


def test_fingerprint_likeness():
    rng = random.Random(2)
    text = " ".join(str(rng.random()) for _ in range(300))
    other = " ".join(str(rng.random()) for _ in range(300))
    mark = fingerprints.fingerprint
    changed = text[:2000] + "a few other words" + text[2100:]
    assert fingerprints.likeness(mark(text), mark(changed)) > 0.8
    assert fingerprints.likeness(mark(text), mark(other)) < 0.2
    assert all(len(s) <= 64 for t in (text, "x", "x" * 100_000) for s in mark(t).split(":")[1:])


def naive_lines(rows, least):
    lines = {d: (t.split("\n") if t is not None else []) for d, t in rows}
    seen, gone = set(), {d: set() for d in lines}
    for d in sorted(lines):
        own = [(i, x) for i, x in enumerate(lines[d]) if x]
        for p in range(len(own)):
            m, chars = 0, 0
            while p + m < len(own) and chars < least:
                chars += len(own[p + m][1])
                m += 1
            if chars >= least:
                run = tuple(x for _, x in own[p : p + m])
                if run in seen:
                    gone[d] |= {i for i, _ in own[p : p + m]}
                seen.add(run)
    return {d: (len(lines[d]), len(gone[d]), "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d])) for d in lines}


def test_line_runs_equal_brute_force(make):
    rng = random.Random(3)
    short = [c * 4 for c in "abcdefgh"]
    rows = [(i, "\n".join(rng.choice([*short, "", "a line of its own that is rather long " * 2]) for _ in range(rng.randrange(40)))) for i in range(40)]
    rows += [(90, ""), (91, "\n\n"), (92, "x" * 30_000), (93, "x" * 30_000), (94, "\n".join(["aaaa"] * 200))]
    documents = make([(*r, 1) for r in rows], "doc_id long, text string, pos long")
    for least in (4, 13, 30):
        found = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["text"]) for r in line_dedup.dedup_lines(documents, least).collect()}
        assert found == naive_lines(rows, least)
    odd = make([(None, "long enough to count " * 5), (1, "long enough to count " * 5), (1, "long enough to count " * 5), (2, None)], "doc_id long, text string")
    found = sorted(line_dedup.dedup_lines(odd).collect(), key=str)
    assert [r["n_deleted"] for r in found if r["doc_id"] == 1] == [0, 0]
    assert [r["n_deleted"] for r in found if r["doc_id"] is None] == [1] and [r["text"] for r in found if r["doc_id"] == 2] == [None]
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def naive_whole_runs(rows, least):
    """Every stretch of at least ``least`` characters that has an earlier place, whatever its number of lines."""
    lines = {d: t.split("\n") for d, t in rows}
    seen, gone = set(), {d: set() for d in lines}
    for d in sorted(lines):
        own = [(i, x) for i, x in enumerate(lines[d]) if x]
        for p in range(len(own)):
            for q in range(p + 1, len(own) + 1):
                run = tuple(x for _, x in own[p:q])
                if sum(map(len, run)) >= least:
                    if run in seen:
                        gone[d] |= {i for i, _ in own[p:q]}
                    seen.add(run)
    return {d: (len(gone[d]), "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d])) for d in lines}


def test_whole_line_runs_equal_brute_force(make):
    rng = random.Random(6)
    lines = [c * n for c in "abcdefgh" for n in (1, 5, 14)]
    blocks = ["\n".join(rng.choices(lines, k=rng.randrange(2, 9))) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice([*blocks, *lines, ""]) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows += [(90, "\n".join(["x" * 30, "y" * 30, "Les.", "one end"])), (91, "\n".join(["x" * 30, "y" * 30, "Les.", "quite another end " * 4]))]
    documents = make(rows, "doc_id long, text string")
    for least in (10, 50):
        found = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in line_dedup.dedup_lines(documents, least, whole_runs=True).collect()}
        assert found == naive_whole_runs(rows, least)
    assert found[91] == (3, "quite another end " * 4)


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_benchmark_passages(make):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(12, 60)))) for i in range(40)]
    rows, planted = [], set()
    for i, text in items:
        w, k = text.split(), int(len(text.split()) * 0.1)
        for _ in range(k):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice(([], [rng.choice(vocabulary)], [w[p], rng.choice(vocabulary)]))
        rows.append((i, " ".join([*rng.choices(vocabulary, k=100), *w, *rng.choices(vocabulary, k=100)]).upper() if i % 2 else " ".join(w)))
        planted.add((i, i))
    rows += [(1000 + i, " ".join(rng.choices(vocabulary, k=200))) for i in range(40)] + [(2000, None), (2001, ""), (None, items[0][1])]
    benchmark = make([*items, (None, items[1][1]), (77, None), (78, "..."), (79, "")], "item_id long, text string")
    documents = make([(*r, 0) for r in rows], "doc_id long, text string, distance long")
    found = decontamination.contaminated(documents, benchmark).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found if r["item_id"] is not None}
    assert len(pairs & planted) >= 0.95 * len(planted) and pairs - planted == {(None, 0)}
    assert all(r["distance"] <= 0.15 * r["item_words"] for r in found)
    clean = decontamination.without_benchmark(documents, benchmark)
    assert clean.columns == documents.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in pairs}
    assert decontamination.contaminated(documents, benchmark.limit(0)).count() == 0
    assert decontamination.contaminated(documents.limit(0), benchmark).count() == 0
    for _ in range(50):
        a, b = rng.choices(range(4), k=rng.randrange(1, 9)), rng.choices(range(4), k=rng.randrange(12))
        assert decontamination.distance_within(a, b) == edit_distance_within(a, b)


def test_no_passage_at_the_allowed_distance_is_lost():
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(20_000)]
    texts = [" ".join(rng.sample(vocabulary, n)) for n in (15, 20, 40, 60, 100, 150, 200, 250, 300) for _ in range(12)]
    own = decontamination.Items.build(list(range(len(texts))), texts, {}, 0.15, 0.99)
    documents = []
    for text in texts:
        w = text.split()
        for _ in range(int(len(w) * 0.15)):  # all that are allowed, of all kinds
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice(([], [rng.choice(vocabulary)], [w[p], rng.choice(vocabulary)]))
        documents.append(" ".join([*rng.choices(vocabulary, k=150), *w, *rng.choices(vocabulary, k=150)]))
    found = {(doc, i) for doc, i, _, _ in own.search(documents)}
    assert found == {(i, i) for i in range(len(texts))}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Head&amp;line</h1><p><b>First &lt;b&gt;<br>line<p>Second&nbsp; one<aside>Read also</aside><div class="ad">Buy</div>
<form><p>Mail</p></form><!-- <p>no</p> --><p>Third</article><section id="comments"><p>Nice</p></section><footer>&copy; x</footer>"""


def test_blocks_of_a_page():
    main = [t for zone, t in html_extraction.page_blocks(PAGE) if zone == html_extraction.MAIN]
    assert main == ["Head&line", "First <b> line", "Second one", "Third"]
    for odd in (None, "", "no markup", "<p", "<<>>", "</div></p>", "<script>x", "<article>" * 500):
        html_extraction.page_blocks(odd)
    assert html_extraction.page_blocks("just & text") == [(html_extraction.OPEN, "just & text")]


def test_names_are_whole_and_leave_articles():
    def main(source):
        return [t for zone, t in html_extraction.page_blocks(source) if zone == html_extraction.MAIN]

    for wrapper in ("layout has-sidebar", "no-comments", "ad-free", "social", "widget"):
        assert main(f"<div class='{wrapper}'><article><p>text</p></article></div><div class='ad'>x</div>") == ["text"]
        assert main(f"<div id='{wrapper}'><main>text</main></div>") == ["text"]
    inside = "<h2 id='share-prices'>a</h2><h2 id='comments'>b</h2><section id='social-history'><p>c</p></section><p class='notice-period'>d</p><p class='lead'>e</p>"
    assert main(f"<article>{inside}</article>") == list("abcde")
    out = "<div class='ad'>1</div><p class='share'>2</p><div id=comments><article>3</article></div><div class='x cookie-notice'>4</div><div class='site-footer'>5</div>"
    assert main(f"<article><p>text</p>{out}</article>") == ["text"]
    assert main("<article>text</article><div class='related'><article>teaser</article></div><div id='comments'><article>reply</article></div>") == ["text"]
    assert main("<nav><article>menu</article></nav><article hidden>x</article><main>text</main>") == ["text"]


def test_repeated_runs_of_a_host(make):
    notice = "this site stores data on your device for many good purposes"
    page = "<body><div>{}</div><div>unique text number {} of this page</div></body>"
    rows = [(i, f"http://a.example.com/{i}", page.format(notice, i), 1) for i in range(5)]
    rows += [(10, "http://b.example.com/", page.format(notice, 10), 1), (11, None, None, 1), (12, "x", "", 1)]
    rows += [(20 + i, f"http://c.example.com/{i}", f"<article><p>{notice}</p></article>", 1) for i in range(4)]
    found = {r["page_id"]: r["text"] for r in html_extraction.main_texts(make(rows, "page_id long, url string, html string, text long")).collect()}
    assert [found[i] for i in range(5)] == [f"unique text number {i} of this page" for i in range(5)]
    assert found[10] == f"{notice}\nunique text number 10 of this page" and found[11] == found[12] == ""
    assert all(found[20 + i] == notice for i in range(4))
    assert html_extraction.main_texts(make([], "page_id long, url string, html string")).count() == 0


def test_repeated_runs_go_to_their_last_word(make):
    run = "read more of our stories in the weekly letter that we send to all friends"
    rows = [(i, f"http://a.example.com/{i}", f"<div>own{i} words{i} before{i} {run} and{i} after{i}</div><div>last{i} words{i}</div>") for i in range(4)]
    rows += [(9, "http://b.example.com/", f"<div>one {run} two</div>")]
    found = {r["page_id"]: r["text"] for r in html_extraction.main_texts(make(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(4)] == [f"own{i} words{i} before{i} and{i} after{i}\nlast{i} words{i}" for i in range(4)]
    assert found[9] == f"one {run} two"


def test_lists_as_of_the_fetch(make):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    log = [
        ("l", False, "domain", "example.com", day(1), "add"), ("l", False, "domain", "example.com", day(5), "remove"), ("l", False, "domain", "example.com", day(1), "add"),
        ("l", False, "domain", "example.com", day(9), "add"), ("m", False, "prefix", "x.org/bad", day(0), "add"), ("t", True, "host", "ok.example.com", day(2), "add"),
        ("l", False, "domain", "never.net", day(3), "remove"), ("l", False, "domain", None, day(3), "add"), ("l", False, "host", "no.time", None, "add"),
    ]
    entries = make(log, "list string, allows boolean, kind string, value string, at timestamp, action string")
    asked = [
        (1, "http://a.example.com/x", day(0), False), (2, "http://a.EXAMPLE.com:80/x", day(1), True), (3, "http://u@example.com./", day(5), False), (4, "http://example.com", day(20), True),
        (5, "http://ok.example.com/", day(3), False), (6, "http://x.org/bad/y?z", day(1), True), (7, "http://x.org/badly", day(1), False), (8, None, day(1), False),
        (9, "http://notexample.com/", day(1), False), (10, "http://example.com", None, False), (11, "nonsense", day(1), False),
    ]
    captures = make([(c, u, a, "x") for c, u, a, _ in asked], "capture long, url string, at timestamp, blocked string")
    found = {r["capture"]: r["blocked"] for r in url_filters.evaluate(captures, entries).collect()}
    assert found == {c: b for c, _, _, b in asked}
    assert url_filters.evaluate(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0


def test_lists_of_top_level_domains_and_capitals(make):
    start = dt.datetime(2024, 1, 1)
    log = [("l", False, kind, value, start, "add") for kind, value in (("domain", "zip"), ("domain", "Example.COM"), ("host", "WWW.x.org"), ("prefix", "Y.org/Bad"), ("prefix", "z.org/"))]
    entries = make(log, "list string, allows boolean, kind string, value string, at timestamp, action string")
    asked = [("http://a.b.zip/", True), ("http://zip/", True), ("http://a.example.com/", True), ("http://www.x.org/", True), ("http://y.org/Bad/q", True), ("http://y.org/bad", False), ("http://z.org", True), ("http://a.gzip/", False)]
    captures = make([(i, u, start) for i, (u, _) in enumerate(asked)], "capture long, url string, at timestamp")
    found = {r["url"]: r["blocked"] for r in url_filters.evaluate(captures, entries).collect()}
    assert found == dict(asked)


@pytest.mark.parametrize("piece", ['<a "', "<a '\"", "<a ", "<a\"'", "<!", "</", "<svg>", "<object><", "<div></p>", '<a "x\' '])
def test_hostile_pages_take_linear_time(piece):
    start = time.time()
    assert html_extraction.page_blocks("<article><p>one two" + piece * (3_000_000 // len(piece)) + ">")
    assert time.time() - start < 20


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("a <math><mi>x</mi></math> b", "a x b"), ("a <svg> b</p><p>c", "a b\nc"), ("a <svg><text>no</text></svg> b", "a b"),
        ("a <object data=x> b", "a b"), ("a <canvas/> b", "a b"), ("a <script>if (x < '</p>') {}</script> b", "a b"), ("1 < 2 <b title='>'>c</b>", "1 < 2 c"),
        ("a <script>never closed", "a"),
        ("a</p><div class='user-comments'>no</div><div class='commentThread'>no</div><div class='google-ads'>no</div><div id='cookiebar'>no</div><p>b", "a\nb"),
    ],
)
def test_texts_of_articles(inner, text):
    blocks = html_extraction.page_blocks(f"<nav>menu</nav><article><p>{inner}</p></article><footer>end</footer>")
    assert "\n".join(words for zone, words in blocks if zone == html_extraction.MAIN) == text
