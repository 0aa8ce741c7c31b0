"""What a larger table must not multiply: Python objects of a task, shuffled postings, pairs of queries and relevant documents."""

import io
import random
import tracemalloc
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import answers, evaluate, index, retrieval
from quillstone.plans import queries as catalogue


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_blocks_of_postings_move_no_token(spark):
    """spans that lie in two batches, words in several languages, a text without words."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(50)] + ["été", "слово"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 20))) for _ in range(3000)] + ["", "..."]
    chunks = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    made = index.blocks(chunks, 9.5)
    assert plan_of(made).count("Exchange") == 1 and "Generate" not in plan_of(made)  # the one that this test deals rows by
    got = {}
    for r in made.collect():
        assert len(r.rows) == len(r.tf) == len(r.dl) == r.n <= index.SPAN and list(r.rows) == sorted(set(r.rows))
        weights = [tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / 9.5)) for tf, dl in zip(r.tf, r.dl, strict=True)]
        assert r.weight == pytest.approx(max(weights))
        for row, tf, dl in zip(r.rows, r.tf, r.dl, strict=True):
            key = (r.term, r.span * index.SPAN + row)
            assert key not in got
            got[key] = (tf, dl)
    want = {(w, i): (t.split().count(w), len(t.split())) for i, t in enumerate(texts) if t != "..." for w in set(t.split())}
    assert got == want


def test_stored_search_multiplies_no_posting_by_queries(spark, tmp_path, monkeypatch):
    """F1, F2: more queries than are scored at a time, equal scores, and no row for each query and posting."""
    monkeypatch.setattr(index, "SPAN", 16)
    monkeypatch.setattr(index, "QUERIES", 3)
    rnd = random.Random(7)
    texts = [" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 6))) for _ in range(200)]
    chunks = spark.createDataFrame([(f"sentence:{i:03}:0", i, "sentence", 0, t, t, 1) for i, t in enumerate(texts)], "chunk_id string, doc_id long, strategy string, ordinal long, text string, display_text string, n_tokens long")
    queries = spark.createDataFrame([(q, rnd.choice(texts)) for q in range(8)], "qid long, text string")
    index.save(str(tmp_path / "i"), chunks)
    parts = index.load(spark, str(tmp_path / "i"))
    rows = lambda df: sorted((r.qid, r.chunk_id, round(r.score, 4), r["rank"]) for r in df.collect())
    assert rows(index.bm25(parts, queries, 9)) == rows(retrieval.bm25(chunks, queries, 9))
    assert "explode(arrays_zip" not in plan_of(index.searched(parts, queries, 9)[0])


def test_vectors_may_be_made_of_the_chunks_as_written(spark, tmp_path):
    chunks = spark.createDataFrame([("a:1:0", 1, "a", 0, "Abc z", "Abc z", 4), ("a:2:0", 2, "a", 0, "..", "..", 2)], "chunk_id string, doc_id long, strategy string, ordinal long, text string, display_text string, n_tokens long")
    seen = []

    def vectors(made):
        seen.append(made.inputFiles())
        return made.select("chunk_id", "strategy", catalogue.letters(F.col("text")).alias("embedding"))

    index.save(str(tmp_path / "i"), chunks, vectors)
    assert len(seen) == 1 and all("quillstone-" in f for f in seen[0])
    got = {r.chunk_id: r.embedding for r in index.load(spark, str(tmp_path / "i"))["vectors"].collect()}
    assert got["a:1:0"] == [0.5, 0.5, 0.5, *[0.0] * 22, 0.5] and got["a:2:0"] == [0.0] * 26
    nulls = spark.createDataFrame([(None,), ("İK",)], "t string").select(catalogue.letters(F.col("t")).alias("v")).collect()
    assert nulls[0].v is None and nulls[1].v[8] == nulls[1].v[10] == pytest.approx(np.sqrt(0.5))


def test_a_task_holds_few_texts_as_objects_whatever_its_batch(spark):
    """ten times the rows in a batch, the same Python objects at a time."""
    def peak(n):
        texts = pa.array([f"{k} {'word ' * 200}" for k in range(n)])
        run = T.by_rows(lambda t: [t[:500], t[500:]], "array<string>").func
        tracemalloc.start()
        out = run(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == n and out[n - 1].as_py()[0].startswith(f"{n - 1} word")
        return most

    assert peak(10_000) < 1.5 * peak(1_000)
    got = spark.createDataFrame([(1, "a  b"), (2, None), (3, "")], "k int, t string").coalesce(1).select("k", T.nfc(F.col("t")).alias("n"), T.normalize(F.col("t")).alias("t")).orderBy("k").collect()
    assert [(r.n, r.t) for r in got] == [("a  b", "a b"), (None, ""), ("", "")]


def test_passages_are_normalized_once_for_all_claims(spark):
    """The function of texts comes before the claims of an answer are told apart."""
    rows = [(1, "The first claim tells of plums. The second claim tells of 17 figs.", ["It tells of  plums and a claim", "17 figs"]), (2, "Nothing of it is known anywhere.", [])]
    said = spark.createDataFrame(rows, "aid long, answer string, passages array<string>")
    lines = plan_of(answers.grounded_v1(said)).split("\n")
    at = lambda word: [k for k, x in enumerate(lines) if word in x]
    assert at("posexplode") and max(at("posexplode")) < min(at("ArrowEvalPython"))  # plans are read from below
    claims = spark.createDataFrame([(1, "17 figs", ["x", "17 figs"])], "aid long, claim string, passages array<string>")
    own = answers.grounding_v1(claims)
    shared = answers.grounding_v1(claims.withColumn("passage_sets", answers.passage_sets(F.col("passages"))).drop("passages"))
    assert own.collect() == shared.collect() and own.first().supporting == [1]


def test_relevance_by_label_makes_no_pairs(spark):
    """the same flags as from all pairs, with documents and queries of several labels, and one whose label nothing has."""
    rnd = random.Random(2)
    documents = spark.createDataFrame([(d, rnd.choice("abc")) for d in range(12) for _ in range(2)] + [(None, "a"), (3, None)], "doc_id long, label string")
    queries = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "a"), (4, "z"), (5, None), (None, "a")], "qid long, label string")
    hits = spark.createDataFrame([(q, d, k + 1) for q in range(1, 6) for k, d in enumerate(rnd.sample(range(12), 12))], "qid long, doc_id long, rank long")
    relevant = evaluate.qrels(queries.join(documents, "label"), "qid", "doc_id")
    want, got = evaluate.hit_flags(hits, relevant), evaluate.hit_flags_by_label(hits, queries, documents)
    assert want.columns == got.columns and sorted(want.collect()) == sorted(got.collect()) and got.count() == 3


def test_scripts_are_told_apart_in_what_is_left_of_a_text(spark):
    """ties by what comes first, scripts of one run and of many, none, null; and no more passes over a text than three."""
    texts = {"abc": "en", "अबa": "hi", "aअ": "en", "अa": "hi", "ab অআই ক": "bn", "اردو a": "ur", "12 ..": "en", "": "en", "漢字": "en", "é漢": "en", "தa தமி": "ta", "ఆఆ ಅಅ": "te", "ಅಅ ఆఆ": "kn"}
    df = spark.createDataFrame([(t, lang) for t, lang in texts.items()] + [(None, None)], "t string, lang string").select("t", "lang", T.script_lang(F.col("t")).alias("got"), T.estimate_tokens(F.col("t")).alias("n"))
    rows = df.collect()
    assert {r.t: r.got for r in rows if r.t is not None} == texts and [r.n for r in rows if r.t in ("abc", "漢字", "")] == [1, 0, 1]
    assert plan_of(df.select("got")).count("regexp_replace(t#") <= 3
