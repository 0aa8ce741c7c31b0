"""Filter audit, source divergence and SimHash against plain Python."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash

from quillstone.llm import common, filter_audit, gray_simhash, source_divergence

DOCS = "doc_id long, text string, lang string, source string"


# filter audit


def audited(rows, labels):
    """Every row's mask by the contract's words, then each order walked document by document."""
    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = good or quality == 1, bad or toxic == 1
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        docs.append((part or "", {k for k, v in fails.items() if v}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    removed_in_all = Counter()
    for order in permutations("ABCDE"):
        for part, fails, _, _ in docs:
            first = next((x for x in order if x in fails), None)
            removed_in_all[part, first] += 1
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                alive = [d for d in own if not d[1] & before]
                here = [d for d in alive if letter in d[1]]
                out[part, "".join(order), step] = (
                    len(alive) - len(here), len(here), sum(letter in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {letter} for d in own),
                    sum(d[2] for d in here), sum(d[3] for d in here), removed_in_all[part, letter],
                )
    return out


def audit(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, None, s) for i, t, s in rows], DOCS)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_audit_equals_brute_force(spark):
    rnd = random.Random(11)
    texts = ["", None, "#", "SHOUT NOW", "a b", "é" * 60, " ".join(f"w{k}" for k in range(60)), "same " * 70, "Same " * 70, " ".join(f"W{k}|" for k in range(80))]
    rows = [(i, rnd.choice(texts), rnd.choice(["a", "a", "a", "b", None, ""])) for i in range(120)]
    rows += [(5, texts[6], "a"), (5, texts[6], "a"), (7, "other text", "b"), (None, texts[6], "b"), (None, None, "c"), (-3, "", "b")]
    rnd.shuffle(rows)
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, 2])) for i in range(0, 100, 2)] + [(4, 1, 1), (None, 1, 1), (900, 1, 1)]
    assert audit(spark, rows, labels) == audited(rows, labels)


def test_a_text_that_fills_many_ranges_has_one_first_row(spark):
    """A third of the rows share a text, which crosses the ends of ranges; repeated rows and texts of equal fingerprints too."""
    rows = [(i, "the same text " * 30 if i % 3 else f"text {i}", "s") for i in range(900)] + [(1, "the same text " * 30, "s")] * 3
    found = filter_audit.masks(spark.createDataFrame([(i, t, None, s) for i, t, s in rows], DOCS)).collect()
    assert sum(r.n for r in found) == len(rows)
    kept = Counter()
    for r in found:
        if not r.mask & filter_audit.E:
            kept[r.doc_id] += r.n
    assert kept == Counter({1: 4, **{i: 1 for i in range(0, 900, 3)}})


def test_texts_with_one_fingerprint_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda c: filter_audit.F.lit(7).cast("long"))
    rows = [(i, f"text {i % 5}", "s") for i in range(200)]
    found = filter_audit.masks(spark.createDataFrame([(i, t, None, s) for i, t, s in rows], DOCS)).collect()
    assert {r.doc_id for r in found if not r.mask & filter_audit.E} == {0, 1, 2, 3, 4}


def test_counters_are_additive(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    counted = filter_audit.counters(filter_audit.masks(docs), labels).collect()
    assert sum(r.n for r in counted) == docs.count() and sum(r.good for r in counted) == 1 and sum(r.toxic for r in counted) == 1
    assert len(counted) == len({(r.part, r.mask) for r in counted})


def test_audit_cases(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part", "2 AS n", "3 AS mask")
    rows = filter_audit.audit(awkward, labels).collect()
    assert len(rows) == 600 and all(r.part == "src" for r in rows)
    first = next(r for r in rows if r.filter_order == "ABCDE" and r.step == 1)
    assert (first.kept, first.removed, first.good_lost) == (1, 8, 2)  # 30,000 words are enough; rows of a labelled id count each
    assert filter_audit.audit(awkward.limit(0), labels).count() == 0
    assert filter_audit.audit(awkward, labels.limit(0)).where("good_lost > 0").count() == 0


@pytest.mark.parametrize("limit", [1, 3, 10, 1000])
def test_word_runs_are_the_words(limit):
    raw = b"  one two\x0bthree\x1cfour \xc3\xa9  five" + b"x" * 30 + b" \r\n"
    assert [w for run in common.word_runs(raw, limit) for w in run] == raw.split()


# source divergence


def diverging(rows, least_docs=3, top=200):
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in in_docs.items() if n >= least_docs]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        of_lang = Counter(t for d in own for t in d[2])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(of_lang)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


LOWER = {k: k + 32 for k in range(65, 91)}


def divergent(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, lang, s) for i, (t, lang, s) in enumerate(rows)], DOCS)
    return [tuple(r) for r in source_divergence.divergences(docs, **options).collect()]


def invented(seed, n=150):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "naïve", "漢字", "x", "İstanbul", "foo_bar", "a1b", "don't", "ſ", "K", *[f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]]
    rows = [(" ".join(rnd.choice(words[: rnd.randint(3, len(words))]) + rnd.choice(["", ".", "\x7f", "1"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s1", "s2", "s3", None, ""])) for _ in range(n)]
    return [*rows, (None, "en", "null only"), ("", "xx", "one"), (None, "xx", "two"), ("only once", "yy", "alone"), *[rows[0]] * 3]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergences_equal_brute_force(spark, seed):
    rows = invented(seed)
    got = divergent(spark, rows)
    assert len(got) == len(set(got)) and set(got) == diverging(rows)


def test_top_and_least_documents(spark):
    rows = invented(3)
    assert set(divergent(spark, rows, top=5, least_docs=2)) == diverging(rows, 2, 5)


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    rows = [("word Other " * 500 + "x" * 3000 + " end", "en", "a"), ("tail", "en", "a"), ("word other end " * 3, "en", "b"), ("ünd " * 900 + "word", "en", "b"), ("ünd end", "en", "a"), ("ünd", "en", "c")]
    docs = spark.createDataFrame([(i, t, lang, s) for i, (t, lang, s) in enumerate(rows)], DOCS)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in rows])], names=["text"])
    monkeypatch.setattr(source_divergence, "PART", 700)
    found = Counter()
    for lowered, offsets, numbers, _ in source_divergence.parts(batch):
        starts, ends, doc = source_divergence.boundaries(lowered, offsets)
        names, place = source_divergence.grouped(lowered, starts, ends)
        found.update((int(numbers[d]), names[p].decode()) for d, p in zip(doc.tolist(), place.tolist(), strict=True))
    want = Counter((k, t.translate(LOWER)) for k, (text, _, _) in enumerate(rows) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
    assert found == want
    assert {tuple(r) for r in source_divergence.divergences(docs).collect()} == diverging(rows)


def test_slices_of_one_hash_stay_apart():
    """A hash that tells nothing apart: the bytes do."""
    rnd = random.Random(4)
    words = [bytes(rnd.choices(b"ab", k=rnd.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(400)]
    lowered = np.frombuffer(b"\x00".join(words), np.uint8)
    starts, ends, _ = source_divergence.boundaries(lowered, np.array([0, len(lowered)]))
    names, place = source_divergence.grouped(lowered, starts, ends, digest=lambda s: 1)
    assert [names[k] for k in place.tolist()] == words and len(set(names)) == len(names)
    names, place = source_divergence.grouped(lowered, starts, ends, digest=lambda s: xxhash.xxh32_intdigest(s) % 7)
    assert [names[k] for k in place.tolist()] == words


def test_boundaries_at_the_ends_of_documents():
    raw = [b"ab", b"cd", b"", b" e", b"f ", b""]
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    starts, ends, doc = source_divergence.boundaries(source_divergence.LOWER[np.frombuffer(b"".join(raw), np.uint8)], offsets)
    assert list(zip(starts.tolist(), ends.tolist(), doc.tolist(), strict=True)) == [(0, 2, 0), (2, 4, 1), (5, 6, 3), (6, 7, 4)]


def test_shares_are_exact():
    rnd = random.Random(5)
    for _ in range(200):
        total = rnd.randrange(1, 9 * 10**15)
        count = rnd.randrange(0, total)
        assert int(source_divergence.share(np.array([count]), total)[0]) == 1 + 10**9 * (count + 1) // total


def test_totals_that_are_joined(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "GROUPS", 2)
    rows = invented(6)
    assert set(divergent(spark, rows)) == diverging(rows)


def test_tasks_that_send_often(spark, monkeypatch):
    rows = invented(7)
    docs = spark.createDataFrame([(i, t, lang, s) for i, (t, lang, s) in enumerate(rows)], DOCS).coalesce(1)
    src = docs.na.fill("", ["lang", "source", "text"])
    one = source_divergence.merged(source_divergence.matrices(src, 3), 3, 3).orderBy("bucket", "lang").drop("sources", "columns", "totals").collect()
    assert {(r.lang, t) for r in one for t in bytes(r.terms).split()} == {(lang, t.encode()) for lang, t in kept_terms(rows)}


def kept_terms(rows):
    found = Counter((lang or "", t) for text, lang, _ in rows for t in {x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")})
    return {k for k, n in found.items() if n >= 3}


def test_divergence_cases(spark, awkward):
    assert source_divergence.divergences(awkward).count() == 0  # one source, and no term in three documents
    more = awkward.unionByName(awkward.withColumn("source", awkward.lang))
    assert [(r.source, r.item, r.value) for r in source_divergence.divergences(more).where("part = 'pair'").orderBy("source").collect()] == [("src", "xx", 0), ("xx", "src", 0)]
    assert source_divergence.divergences(awkward.limit(0)).count() == 0


# SimHash


def plain_simhash(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def reached(prints, most=4):
    """Least index reachable by links between any two."""
    label = list(range(len(prints)))
    pairs = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= most]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_prints(seed, n=700):
    """Chains and balls of fingerprints around a few centres, and others."""
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 5, 40])):
            out.add(x)
            for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 4, 5, 6])):
                x ^= 1 << b
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "One two three", "a b c d", "A B c d e f", "rep rep rep rep rep rep", "é漢 \x1c x y z w", "word " * 500])
def test_simhash_of_texts(text):
    assert gray_simhash.simhash((text or "").encode()) == plain_simhash(text)


def test_simhash_of_a_long_text_in_parts(monkeypatch):
    rnd = random.Random(8)
    text = " ".join(rnd.choice("abcdefgh") for _ in range(400))
    monkeypatch.setattr(gray_simhash, "word_runs", lambda raw: common.word_runs(raw, 5))
    assert gray_simhash.simhash(text.encode()) == plain_simhash(text)


def test_native_hash_is_the_same(spark):
    assert [r.h for r in spark.sql("SELECT xxhash64(x) AS h FROM VALUES ('a b c d'), ('é') t(x)").collect()] == [gray_simhash.signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in ("a b c d", "é")]


def test_gray_neighbours_differ_in_one_bit():
    x = np.arange(256, dtype=np.uint64)
    by_rank = x[np.argsort(gray_simhash.gray_rank(x))]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


@pytest.mark.parametrize("most", [0, 1, 4, 7])
def test_blocks_keep_every_near_pair(most):
    rnd = random.Random(most)
    for mask in (0, 0xFFFF0000FFFF, (1 << 60) - 1, (1 << 64) - 1):
        own = gray_simhash.blocks(mask, most)
        assert len(own) == most + 1 and all(b & mask == mask for b in own)
        for _ in range(200):
            a, spoiled = rnd.getrandbits(64), 0
            for b in rnd.sample(range(64), most):
                spoiled |= (1 << b) & ~mask
            assert any((a & b) == ((a ^ spoiled) & b) for b in own)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forest_spans_what_all_pairs_link(seed):
    prints = near_prints(seed)
    rnd = random.Random(seed)
    groups = np.array([rnd.choice([0, 0, 0, 1, 2]) for _ in prints])
    v, w = gray_simhash.forest(np.array(prints, np.uint64), groups, 4)
    for g in range(3):
        own = [p for p, x in zip(prints, groups.tolist(), strict=True) if x == g]
        want = reached(own)
        place = {p: k for k, p in enumerate(own)}
        label = list(range(len(own)))

        def root(k, label=label):
            while label[k] != k:
                k = label[k]
            return k

        edges = [(place[a], place[b]) for a, b in zip(v.tolist(), w.tolist(), strict=True) if a in place and b in place]
        for a, b in edges:
            label[max(root(a), root(b))] = min(root(a), root(b))
        assert len(edges) == len(own) - len(set(want))
        assert [want[k] for k in range(len(own))] == [want[root(k)] for k in range(len(own))] and len({root(k) for k in range(len(own))}) == len(set(want))


@pytest.mark.parametrize("group", [1 << 16, 40])
def test_links_with_groups_dealt_again(spark, monkeypatch, group):
    """With small groups, those that many fingerprints share are dealt a second and third time."""
    monkeypatch.setattr(gray_simhash, "GROUP", group)
    rnd = random.Random(9)
    alike = [0xABCDEF0123456789 ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for _ in range(300)]
    prints = sorted({*near_prints(4, 300), *alike})
    rows = [(gray_simhash.signed(p),) for p in prints]
    found = gray_simhash.links(spark.createDataFrame(rows, "print long"), 4, 3).read().collect()
    place = {gray_simhash.signed(p): k for k, p in enumerate(prints)}
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for r in found:
        a, b = root(place[r.v]), root(place[r.w])
        label[max(a, b)] = min(a, b)
    assert [root(k) for k in range(len(prints))] == reached(prints)


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(10)
    words = [f"w{k}" for k in range(900)]
    texts = [None, "", "three Words only", "THREE words only", "three words  only"]
    for _ in range(60):
        own = rnd.sample(words, rnd.choice([3, 5, 20, 120, 400]))
        for _ in range(rnd.randint(1, 4)):
            texts.append(" ".join(own))
            own[rnd.randrange(len(own))] = rnd.choice(words)
    rnd.shuffle(texts)
    rows = [(1000 - k, t, None, None) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in gray_simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    rows.sort()
    prints = [plain_simhash(t) for _, t, _, _ in rows]
    assert [got[i].fingerprint for i, *_ in rows] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i, *_ in rows] == [rows[k][0] for k in reached(prints)]


def test_near_duplicates_of_the_documents(spark, docs, texts):
    got = {r.doc_id: r for r in gray_simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    prints = [plain_simhash(texts[i]) for i in ids]
    assert [got[i].component_id for i in ids] == [ids[k] for k in reached(prints)]


def test_near_duplicate_cases(spark, awkward):
    rows = gray_simhash.near_duplicates(awkward).collect()
    assert len(rows) == 9
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == "0" * 16
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 7, None)] == [1, 1, 1, 4, 7, None]
    assert gray_simhash.near_duplicates(awkward.limit(0)).count() == 0
