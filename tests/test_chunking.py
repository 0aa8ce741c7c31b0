"""Chunkers against plain versions written from their definitions, none of which uses the module's own functions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking
from quillstone.plans import queries

SF = "/root/testdata/sf0.001"
#: As the default tokenizer sees words; \w with combining marks left out.
WORD = re.compile(r"\w+")


def sentences_v2(text):
    out = []
    for part in re.split(r"(?<=[.!?।॥۔؟。！？…])\s+", text):
        if out and re.search(r"(?i)\b(?:[A-Z]|Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|Rev|Hon|vs|etc|Inc|Ltd|Co|Corp|e\.g|i\.e|a\.m|p\.m|U\.S|U\.K|No)\.$", out[-1]):
            out[-1] += " " + part
        elif part:
            out.append(part)
    return [s for s in out if len(s) > 1]


def sentences_v1(text):
    known = set(T.ABBREVIATIONS_V1)
    out = []
    for part in filter(None, re.split(r"(?<=[.!?।॥۔؟。！？])\s+", text)):
        words = out[-1][:-1].split() if out and out[-1].endswith(".") else []
        if out and (words and words[-1].lower().strip(".") in known or len(part) < 15):
            out[-1] += " " + part
        else:
            out.append(part)
    if len(out) > 1 and len(out[0]) < 15:
        out[:2] = [out[0] + " " + out[1]]
    return out


def spans(text):
    return [m.span() for m in WORD.finditer(text)]


def limited(text, limit):
    at = spans(text)
    if len(at) + 2 <= limit or not at:
        return [text]
    return [text[at[k][0] : at[min(k + limit, len(at)) - 1][1]] for k in range(0, len(at), limit)]


def packed(sentences, sizes, budget, overlap, alone):
    groups, now = [], []
    for k, n in enumerate(sizes):
        if alone and n >= budget:
            groups += ([now] if now else []) + [[k]]
            now = []
        else:
            if now and sum(sizes[j] for j in now) + n > budget:
                groups.append(now)
                now = now[len(now) - overlap :] if overlap else []
            now = [*now, k]
    return [" ".join(sentences[j] for j in g) for g in groups + ([now] if now else [])]


def count(text):
    return len(spans(text)) + 2


def fixed_tokens(text):
    at = spans(text)
    if len(at) <= 256:
        return [text] if at else []
    starts = [k for k in range(0, len(at), 192) if k == 0 or len(at) - k > 64]
    return [text[at[k][0] : at[min(k + 256, len(at)) - 1][1]] for k in starts]


def sentence(text):
    own = sentences_v2(text)
    return [p for g in packed(own, list(map(count, own)), 200, 1, True) for p in limited(g, 200)]


def sentence_v1(text):
    own = sentences_v1(text)
    return packed(own, list(map(len, own)), 400, 1, False)


def contextual(text, header="[en] Q: what is it"):
    room = max(200 - count(header), 64)
    own = sentences_v2(text)
    return [f"{header} | {p}" for g in packed(own, list(map(count, own)), room, 0, False) for p in limited(g, room)]


def semantic(text):
    own = sentences_v2(text)
    if len(own) < 3:
        return limited(" ".join(own), 384) if own else []
    v = chunking.hashing_embedder(own)
    distance = [1 - float(a @ b) for a, b in zip(v, v[1:], strict=False)]
    cut, groups = np.percentile(distance, 95), [[0]]
    for k, d in enumerate(distance, 1):
        running = sum(count(own[j]) for j in groups[-1])
        if d > cut and running >= 64 or running + count(own[k]) > 384:
            groups.append([k])
        else:
            groups[-1].append(k)
    return [p for g in groups for p in limited(" ".join(own[j] for j in g), 384)]


def sentence_window(text):
    own = sentences_v1(text)
    return [(s, " ".join(own[max(0, k - 2) : k + 3])) for k, s in enumerate(own)]


def parent_child(text):
    own = sentences_v1(text)
    return [text] if len(own) <= 2 else [f"{a} {b}" for a, b in zip(own, own[1:], strict=False)]


def recursive(text, size=400, overlap=60):
    marks = ["\n\n", "\n", "। ", "॥ ", "۔ ", ". ", "? ", "! ", "؟ ", "; ", ", ", " "]

    def parts(span, level):
        if len(span) <= size:
            return [span]
        for k in range(level, len(marks)):
            if marks[k] in span:
                tail = marks[k] if marks[k].strip() else ""
                return [x for p in span.split(marks[k]) for x in parts(p + tail, k + 1)]
        return [span[k : k + size] for k in range(0, len(span), size)]

    out, now = [], ""
    for p in parts(text, 0):
        if now and len(now) + len(p) > size:
            out.append(now.strip())
            now = now[-overlap:]
        now += p
    return [c for c in [*out, now.strip()] if c]


TRICKY = [
    "We met Dr. Osei at noon. He came from the U.S. and left at 5 p.m. sharp. Yes. No. A. B. It ended well, e.g. like this. Fin.",
    "No. The ferry leaves again in the evening. No. 5 was taken by Prof. Lee of Acme Inc. and others. Ok.",
    "निगम एक कंपनी है जो बड़ी है। यह लोगों का समूह होता है? हाँ। यह कानूनी रूप से मान्य है॥ समाप्त।",
    "Wait... what? etc.. And so on etc. . Then vs. now it is a long one. Été à l'é. L'eau A.I. est là.",
    "word-one, word_two; (three) – four… five! " * 120,
    "no terminator at all " * 150,
    "۔ ؟ ! . ?",
    "Mr. X. Y. Z. said no. vol. 3 of it. " * 30,
]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(2)
    pieces = ["Dr.", "etc.", "e.g.", "No.", "x.", "Y.", "word", "longer words here", "ends.", "ends!", "fin?", "है।", "a", "...", "(b)", "1.5", "U.K.", "min.", "co.", "é."]
    noise = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 90))) for _ in range(150)]
    docs = [" ".join((r.text or "").replace("​", "").replace("﻿", "").split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return [" ".join(t.split()) for t in TRICKY + noise + docs if t.strip()]


def rows_of(spark, texts, name, **columns):
    df = spark.createDataFrame([(k, t, *columns.values()) for k, t in enumerate(texts)], "doc_id long, text string" + "".join(f", {c} string" for c in columns))
    out = {}
    for r in sorted(chunking.get_strategy(name)(df).collect(), key=lambda r: (r.doc_id, r.ordinal)):
        out.setdefault(r.doc_id, []).append(r)
    return out


@pytest.mark.parametrize(("profile", "plain"), [("v1", sentences_v1), ("v2", sentences_v2)])
def test_sentences_equal_plain_ones(spark, texts, profile, plain):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    got = {r.k: r.s for r in df.select("k", T.split_sentences(df.text, profile).alias("s")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain(t), t


@pytest.mark.parametrize(("name", "plain"), [("fixed_tokens", fixed_tokens), ("sentence", sentence), ("sentence_v1", sentence_v1), ("semantic", semantic), ("parent_child", parent_child), ("recursive_character", recursive)])
def test_chunks_equal_plain_ones(spark, texts, name, plain):
    got = rows_of(spark, texts, name)
    for k, t in enumerate(texts):
        assert [r.text for r in got.get(k, [])] == plain(t), t
        assert [r.ordinal for r in got.get(k, [])] == list(range(len(got.get(k, []))))


def test_contextual_chunks_have_a_header_of_the_document(spark, texts):
    got = rows_of(spark, texts, "contextual", query_type="", lang="en", eng_query="what is it")
    for k, t in enumerate(texts):
        assert [r.text for r in got.get(k, [])] == contextual(t), t
        assert all(r.text.endswith(r.display_text) and "Q:" not in r.display_text for r in got.get(k, []))


def test_sentence_windows_equal_plain_ones(spark, texts):
    got = rows_of(spark, texts, "sentence_window")
    for k, t in enumerate(texts):
        assert [(r.text, r.display_text) for r in got.get(k, [])] == sentence_window(t), t


def test_slices_keep_case_and_punctuation(spark):
    text = " ".join(f"Word-{k}, (N{k})!" for k in range(300))
    got = [r.text for r in rows_of(spark, [text], "fixed_tokens")[0]]
    assert all(c in text for c in got) and got[0].startswith("Word-0, (N0)!")
    assert [c for c in limited(text, 50)] == [r.text for r in chunking.enforce_limit(spark.createDataFrame([(1, text)], "doc_id long, text string"), 50).orderBy("ordinal").collect()]


def test_chunks_by_a_vocabulary(spark):
    """Windows and packs in a model's tokens: from the library's own offsets, text by text."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from quillstone.functions.subwords import Vocabulary
    from quillstone.operators import index

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, vocabulary = Tokenizer.from_file(path), Vocabulary(path)
    texts = ["", "short", "naïve café 漢字 😀 " * 40, "An unbroken antidisestablishmentarianism. " * 30, "Dr. Osei waits. " + "word " * 300 + ". And then more words follow here.", "x" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda df: {i: [r.text for r in sorted((r for r in df.collect() if r.doc_id == i), key=lambda r: r.ordinal)] for i in range(len(texts))}
    got = rows(chunking.fixed_tokens(docs, 50, 10, vocabulary))
    for i, t in enumerate(texts):
        offsets = library.encode(t, add_special_tokens=False).offsets
        want, k = [], 0
        while k < len(offsets):
            window = offsets[k : k + 50]
            if len(offsets) <= 50:
                want = [t]
                break
            if k and len(window) <= 10:
                break
            want.append(t[window[0][0] : window[-1][1]].strip())
            k += 40
        assert got[i] == want
    sizes = {r.text: r.n for r in docs.select("text", vocabulary.count(F.col("text")).alias("n")).collect()}
    assert sizes == {t: len(library.encode(t, add_special_tokens=False).ids) + 2 for t in texts}
    for strategy in ("sentence", "contextual"):
        packs = rows(chunking.get_strategy(strategy)(docs, budget=80, tokenizer=vocabulary))
        assert packs[1] == ["short"] and packs[0] == []
        # a slice that is encoded again may merge otherwise at its ends, or repeat a character of several tokens
        assert all(vocabulary.size(c) <= 90 for own in packs.values() for c in own) and max(vocabulary.size(c) for c in packs[3]) > 60
        assert all("".join(c.split()) in "".join(t.split()) for i, t in enumerate(texts) for c in packs[i])
    chunks = index.chunked(docs, ["fixed_tokens", "passage_native"], vocabulary).collect()
    assert {r.strategy for r in chunks} == {"fixed_tokens", "passage_native"} and all(r.n_tokens == vocabulary.size(r.text) for r in chunks)


def test_a_stored_result_of_parent_child_holds_each_text_once(spark, tmp_path):
    """The rows repeat a text beside each of its pairs; written, they grow with the texts and not with the square of their length."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9)))
    long = [" ".join(" ".join(word() for _ in range(25)) + "." for _ in range(200)) for _ in range(50)]
    # more rows than a writer looks at first that repeat nothing, one text that is longer than its dictionary, one that is no text
    texts = [*long, *(" ".join(word() for _ in range(400)) for _ in range(150)), " ".join(word() for _ in range(170_000)) + ". It ends. Or doesn't it now?", "", None, "Short."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'a' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    queries.chunk_parent_child(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    written = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert written < 5 * sum(len(t or "") for t in texts)
    stored, got = spark.read.parquet(f"{tmp_path}/out"), {}
    assert {tuple(r) for r in stored.select("doc_id", "display_text").distinct().collect()} == {(k, t) for k, t in enumerate(texts) if t}
    for r in stored.select("doc_id", "ordinal", "text").collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.text))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == list(enumerate(parent_child(t) if t else []))
