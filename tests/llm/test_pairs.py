import hashlib
import html
import random
import re

import pytest

from quillstone.llm import html_extract, ngram_join, spotsigs


def brute(rows, percent=75):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    label = {i: i for i, _ in rows if i is not None}
    changed = True
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[rows[a][0]], label[rows[b][0]])
            for k in (a, b):
                if label[rows[k][0]] != low:
                    label[rows[k][0]], changed = low, True
    return label, [len(s) for s in sets]


def near_copies(seed):
    """Chains of edits around the threshold, small sets, common passages, exact copies."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    passage = rnd.sample(words, 40)
    for _ in range(25):
        base = rnd.sample(words, rnd.choice([3, 5, 6, 7, 9, 12, 20, 30, 45, 80, 160, 330]))
        if rnd.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rnd.randint(1, 7)):
            rows.append(" ".join(base))
            base = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                k = rnd.randrange(len(base))
                base[k : k + rnd.randint(0, 1)] = [rnd.choice(words)] * rnd.randint(0, 1)
            base = base or ["x"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    label, sizes = brute(rows)
    got = {r.doc_id: r for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].component_id for i, _ in rows} == label
    assert [got[i].n_shingles for i, _ in rows] == sizes


def test_bands_hold_every_linkable_pair_and_enough_segments():
    bands = ngram_join.Bands(75)
    for s in range(1, 400):
        for other in range(s, s * 100 // 75 + 1):
            assert set(bands.of(s)) & set(bands.of(other))
    import numpy as np

    rnd = np.random.default_rng(0)
    for s in (6, 7, 11, 25, 41, 77, 100, 161, 333, 1000, 5000):
        for band in bands.of(s):
            for _ in range(20):
                _, worth = bands.signatures(rnd.integers(0, 2**63, s).astype(np.uint64), band)
                assert worth > bands.spoiled(s, band)


@pytest.mark.parametrize("percent", [60, 75, 90, 100])
def test_needed_signatures_in_sql(spark, percent):
    bands = ngram_join.Bands(percent)
    sizes = [*range(1, 300), 999, 1000, 4097, 30_000, 1_000_003]
    rows = [(s, b % 2, bands.needed(s, b) * (-1 if bands.deletes(b) else 1)) for s in sizes for b in bands.of(s)]
    got = spark.createDataFrame(rows, "size long, parity long, want long").selectExpr("size", "parity", "want", f"{ngram_join.needed_sql(bands)} AS got")
    assert got.where("want <> got").collect() == []


def test_join_cases(spark, awkward):
    rows = ngram_join.join(awkward).collect()
    assert len(rows) == 9
    for r in rows:
        assert r.component_id == r.doc_id
    got = {r.doc_id: r.n_shingles for r in rows}
    assert got[1] == got[2] == got[3] == 0 and got[4] == 1 and got[5] == 1
    assert ngram_join.join(awkward.limit(0)).count() == 0


def test_one_of_each_keeps_columns_and_rows_without_id(spark, awkward):
    more = awkward.unionByName(awkward.where("doc_id = 7").withColumn("doc_id", awkward.doc_id + 10))
    kept = ngram_join.one_of_each(more)
    assert kept.columns == awkward.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, None], key=str)


def test_fingerprints_and_edits(spark, docs, texts):
    order = sorted(texts)
    rows = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    assert set(rows) == set(order)
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(text) // 2
        changed = text[: len(text) - n] + following[:n]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.edited_fingerprint == spotsigs.fingerprint(spotsigs.signatures(changed)) and r.fingerprint == spotsigs.fingerprint(spotsigs.signatures(text))
        assert r.near_next == spotsigs.likeness(spotsigs.signatures(text), spotsigs.signatures(following))


def chains(text):
    """Signatures as strings: each anchor with the two words after it that aren't anchors; all words' chains where there are none."""
    words = re.findall(r"\w+", text.lower())
    found = set()
    for k, w in enumerate(words):
        after = [x for x in words[k:] if x not in spotsigs.ANCHORS][:2] if w in spotsigs.ANCHORS else []
        if len(after) == 2:
            found.add((w, *after))
    if not found:
        found = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else {(text,)}
    return found


def test_likenesses_equal_those_of_chains(spark, texts):
    order = sorted(i for i in texts if len(texts[i]) < 6000)
    rows = {r.doc_id: r for r in spotsigs.fingerprints(spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")).collect()}
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(text) // 2
        own, changed, after = (chains(t) for t in (text, text[: len(text) - n] + following[:n], following))
        assert len(rows[i].fingerprint) == 10 * len(own)
        assert rows[i].near_edited == pytest.approx(len(own & changed) / len(own | changed)) and rows[i].near_next == pytest.approx(len(own & after) / len(own | after))


def test_empty_tables_have_no_pairs_and_no_rows(spark, awkward):
    members, pairs = spotsigs.near_pairs(awkward.limit(0))
    assert members.count() == pairs.count() == 0 and ngram_join.one_of_each(awkward.limit(0)).count() == 0
    members, pairs = spotsigs.near_pairs(awkward)
    assert members.count() == 8


def test_documents_of_one_common_passage_are_not_compared_with_each_other(spark):
    """A passage is three quarters of many texts: too little to link, too much for rare elements alone."""
    rnd = random.Random(4)
    passage = [f"p{k}" for k in range(80)]
    rows = [(k, " ".join([*passage, *(f"d{k}x{j}" for j in range(24))])) for k in range(300)]
    rows += [(1000 + k, " ".join([*passage[: 76 + k], f"e{k}"])) for k in range(4)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    label, _ = brute(rows)
    assert {r.doc_id: r.component_id for r in ngram_join.join(df).collect()} == label
    own = spark.createDataFrame([(i, ngram_join.shingles(t).astype("int64").tolist()) for i, t in rows if i < 1000], "v long, own array<long>")
    across = ngram_join.across_components(own.selectExpr("v", "v AS label"), own, 75)
    assert across.read().count() == 0
    across.drop()


def test_fingerprint_cases(spark, awkward):
    rows = spotsigs.fingerprints(awkward).collect()
    assert len(rows) == 9
    assert len({r.fingerprint for r in rows if r.doc_id == 4}) == 1 and [r.near_next for r in rows if r.doc_id == 4].count(1.0) == 1
    assert spotsigs.fingerprints(awkward.limit(0)).count() == 0
    single = spotsigs.fingerprints(awkward.where("doc_id = 7")).collect()
    assert len(single) == 1 and single[0].near_next == 1


def test_pruned_likeness_is_the_likeness_above_the_threshold():
    texts = [" ".join(f"the w{i} x{i}" for i in range(a, b)) for a, b in ((0, 40), (0, 45), (3, 50), (0, 10), (100, 140))]
    signed = [spotsigs.signatures(t) for t in texts]
    for a in signed:
        for b in signed:
            full = spotsigs.likeness(a, b)
            assert spotsigs.likeness(a, b, 0.6) == full or full < 0.6


@pytest.mark.parametrize("threshold", [0.5, 0.75])
def test_near_pairs_equal_brute_force(spark, threshold):
    rnd = random.Random(9)
    rows = []
    for k in range(40):
        words = [rnd.choice(["the", "of", "and", *[f"w{rnd.randint(0, 300)}" for _ in range(6)]]) for _ in range(rnd.choice([1, 4, 20, 60, 200]))]
        for _ in range(rnd.randint(1, 4)):
            rows.append((len(rows), " ".join(words)))
            words = [w if rnd.random() > 0.04 else "edited" for w in words]
    members, pairs = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), threshold)
    signed = {i: spotsigs.signatures(t) for i, t in rows}
    first = {}
    for i, _ in rows:
        first.setdefault(signed[i].tobytes(), i)
    assert {r.doc_id: r["class"] for r in members.collect()} == {i: first[signed[i].tobytes()] for i, _ in rows}
    classes = sorted(first.values())
    want = {(min(a, b), max(a, b)) for a in classes for b in classes if a < b and spotsigs.likeness(signed[a], signed[b]) >= threshold}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()} == want and want


def page(article, extra="", host="a.example.com", path="/en/1"):
    return f"https://{host}{path}", f"<html><head><title>t</title></head><body><nav><a>Menu</a></nav>{extra}{article}<footer>&copy; x</footer></body></html>"


def test_articles_equal_expected(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", sources[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_differencing_deletes_lines_of_the_real_pages(spark):
    """Menus and footers of these pages vary within a host, so few of them are shared with the nearest page; the rest is left for the marks."""
    rows = html_extract.extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()
    pages, shared, marked = sum(r.n_shared > 0 for r in rows), sum(r.n_shared for r in rows), sum(r.n_marked for r in rows)
    print(f"differencing deletes lines of {pages} of {len(rows)} pages: {shared} lines, markup alone {marked}")
    assert len(rows) == 2500 and pages > 50 and shared >= pages and marked > shared


def test_unmarked_menus_and_footers_go_by_differencing(spark):
    bare = lambda k: f"<html><body><div>Home</div><div>News</div><div>Share this</div><article><h1>Title {k}</h1><p>Told {k}</p></article><div>Imprint</div></body></html>"
    rows = [(k, f"https://h/{k}", bare(k)) for k in range(4)]
    got = {r.page_id: (r.text, r.n_shared, r.n_marked) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: (f"Title {k}\nTold {k}", 4, 0) for k in range(4)}


def test_differencing_settles_pages_without_article(spark):
    rows = [(k, *page(f"<div>Welcome to the site</div><div>Story {k} told here.</div><div>All rights reserved</div>", path=f"/en/{k}")) for k in range(4)]
    rows += [(10, *page("<div>Alone</div>", host="b.example.com")), (11, *page("<main><p>Quoted line</p><p>Own 11</p></main>", path="/q/11")), (12, *page("<main><p>Quoted line</p><p>Own 12</p></main>", path="/q/12"))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(4)] == [f"Story {k} told here." for k in range(4)]
    assert got[10] == "Alone" and got[11] == "Quoted line\nOwn 11" and got[12] == "Quoted line\nOwn 12"


def test_markup_rules():
    text = lambda h: html_extract.settled(html_extract.lines_of(h), None)[0]
    assert text("<article><header><h1>Title</h1></header><p>a &amp; b<p>c\n d<div class='share'>Share</div><section class='comments'><p>Nice!</p></section></article>") == "Title\na & b\nc d"
    assert text("<header>Site</header><aside>Side</aside><p>Body</p><form><input><button>Go</button></form><div id='cookie-notice'>Cookies</div>") == "Body"
    assert text("<p>one<br>two</p><script>x</p></script><style>p{}</style>") == "one\ntwo"
    assert text(None) == text("") == ""


def test_extraction_cases(spark):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "<p>x</p>"), (3, "not a url", "<p>x</p>"), (None, "http://h/a", "<p>y" + "<b>" * 3000), (5, "http://h/b", "plain & text")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and {(r.page_id, r.text) for r in got} >= {(1, ""), (2, ""), (None, "y"), (5, "plain & text")}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_longest_common_subsequence():
    def brute_length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        found = html_extract.shared(a, b)
        assert len(found) == brute_length(a, b)


def test_copies_do_not_erase_each_other(spark):
    story = lambda k: f"<div>Welcome</div><div>Story {k}</div>"
    rows = [(3, "not a url", "<p>x</p>"), (3, "not a url", "<p>x</p>"), (10, *page(story("a"), path="/a")), (11, *page(story("a"), path="/a?print=1")), (12, *page(story("a"), host="m.a.example.com", path="/a"))]
    rows += [(13, *page(story("b"), path="/b")), (20, *page("<div>Alone</div>", host="b.example.com")), (21, *page("<div>Alone</div>", host="www.b.example.com"))]
    got = sorted((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(3, "x"), (3, "x"), (10, "Story a"), (11, "Story a"), (12, "Story a"), (13, "Story b"), (20, "Alone"), (21, "Alone")]


def test_runs_of_copies_over_many_ranges(spark):
    """All pages of one host, copies in runs longer than a range: each is compared with the nearest page that differs."""
    told = [0] * 3 + [1] * 40 + [2, 1, 2] + [3] * 30 + [4]
    rows = [(k, *page(f"<div>Welcome</div><div>Story {n}</div>", path=f"/{k:03d}")) for k, n in enumerate(told)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(k, f"Story {n}") for k, n in enumerate(told)]


def test_differencing_settles_open_lines_beside_articles_and_notices_in_main(spark):
    beside = lambda k: f"<div>Welcome</div><div>Lead {k}</div><article><p>Told {k}</p></article>"
    teaser = lambda k: f"<div>Story {k}</div><div>Imprint</div><article><p>Read on</p></article>"
    notice = lambda k: f"<main><p>We moved house.</p><p>Own {k}</p><article><p>Told {k}</p></article></main>"
    rows = [(k * 10 + i, *page(f(i), host=f"{k}.example.com", path=f"/{i}")) for k, f in enumerate((beside, teaser, notice), 1) for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[10 + i] for i in range(4)] == [f"Lead {i}\nTold {i}" for i in range(4)]
    assert [got[20 + i] for i in range(4)] == [f"Story {i}\nRead on" for i in range(4)]
    assert [got[30 + i] for i in range(4)] == [f"Own {i}\nTold {i}" for i in range(4)]


@pytest.mark.parametrize("order", ["shuffled", "adverse"])
def test_components_of_a_long_chain(spark, order):
    ids = list(range(300))
    random.Random(5).shuffle(ids)
    if order == "adverse":  # only next to the end is a lesser neighbour
        ids = [k for pair in zip(range(150), range(299, 149, -1), strict=True) for k in pair]
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "v long, w long")
    found = ngram_join.components(spark.createDataFrame([(k,) for k in [*ids, 1000]], "v long"), links)
    assert {r.v: r.label for r in found.read().collect()} == dict.fromkeys(range(300), 0) | {1000: 1000}
    found.drop()


@pytest.mark.parametrize("percent", [51, 60, 65])
def test_small_sets_link_at_low_thresholds(spark, percent):
    words = [f"w{i}" for i in range(40)]
    rows = [(10 * k + n, " ".join(words[3 * k : 3 * k + n + 4])) for k in range(4) for n in (1, 3, 5, 8)]
    rnd = random.Random(1)
    rows += [(100 + k, " ".join(rnd.sample(words, rnd.randint(5, 12)))) for k in range(20)]
    label, _ = brute(rows, percent)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == label


def test_thresholds_that_signatures_cannot_serve_are_refused():
    with pytest.raises(ValueError, match="51 percent"):
        ngram_join.Bands(50)
    assert [ngram_join.Bands(p).tops[0] for p in (60, 65, 70, 75)] == [3, 4, 5, 5]
