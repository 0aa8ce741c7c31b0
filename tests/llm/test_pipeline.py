import corpus_pipeline
from quillstone.llm.common import Scratch
from tests.llm.test_pairs import brute
from tests.llm.test_rules import base_quality, base_spans

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = Scratch.write(stage(spark, docs, SF)).read()
        kept[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == columns
    before, after = kept["quality_rules"]
    quality = {i: base_quality(t) for i, t in before.items()}
    assert all(quality[r.doc_id][0] >= 50 and 2 * quality[r.doc_id][4] <= quality[r.doc_id][0] for r in after.collect())
    before, after = kept["ngram_jaccard_join"]
    label, _ = brute(sorted(before.items()))
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in label.items() if i == c)
    before, after = kept["secret_scan"]
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == set(before) and all(r.n_chars == len(r.text) for r in got.values())
    assert all((r.text != before[i]) == bool(base_spans(before[i])) for i, r in got.items())
    before, after = kept["best_fit_packing"]
    assert {r.doc_id for r in after.collect()} == set(before)


def test_pipeline_on_awkward_rows(spark, awkward, tmp_path):
    awkward.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def prose(seed, n=120):
    import random

    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_pipeline_on_awkward_rows_that_pass_the_rules(spark, tmp_path):
    """Copies, repeated ids, no ids, no texts, secrets and very long texts, with columns that clash."""
    long = prose(9, 30_000)
    rows = [(1, prose(1)), (1, prose(1)), (2, prose(1)), (3, prose(3) + " token=abcdefgh12"), (None, prose(4)), (None, prose(4)), (5, long), (6, None), (7, ""), (8, "short"), (9, prose(3) + " token=abcdefgh12 x")]
    df = spark.createDataFrame([(i, t, "xx", "s", len(t or ""), 0, 0, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, words int, rejected_by int, label int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in pieces}, key=str) == [1, 3, 5, None]
    assert sum(r.doc_id is None and r.piece == 0 for r in pieces) == 2 and max(r.piece for r in pieces if r.doc_id == 5) > 10
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and all(r.offset + r.length <= 2048 for r in pieces)


def test_toxicity_stage_drops_what_its_model_flags(spark):
    from quillstone.llm import toxicity

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    scored = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, labels).collect()}
    assert kept == {i for i, toxic in scored.items() if not toxic}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum((i not in kept) == bool(t) for i, t in truth.items()) / len(truth) > 0.97


def test_quality_stage_drops_what_any_rule_rejects(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_low_quality(spark, docs, SF).collect()}
    for r in docs.collect():
        n, chars, symbols, twice, covered = base_quality(r.text)
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", r.text), [x for x in r.text.split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
        rejected = n < 50 or 2 * covered > n or 100 * symbols > 5 * chars or 100 * len(re.findall("[A-Z]", r.text)) > 40 * chars or 100 * len(set(words)) < 20 * n
        rejected = rejected or len(lines) >= 6 and 2 * twice > len(lines) or not 2 * n <= chars <= 25 * n
        assert (r.doc_id in kept) != rejected
