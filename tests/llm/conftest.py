import pytest

SF = "/root/testdata/sf0.001"
#: Nulls, empty and long texts, ties, repeated rows.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a b c"),
    (4, "a b c"),
    (5, "word " * 30_000),
    (6, "é漢😀 Σας ½ Ⅷ <|endoftext|> x\x1cy"),
    (None, "no id here but words enough to make a shingle"),
    (7, "The MIT License and the Apache License and the GNU General Public License."),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """With a column for each name that an operator gives its own."""
    names = "n_tokens words h row key own guest range rank length kept label score toxic severity v w many place component_id ids base all".split()
    rows = [(i, t, "xx", "src", 1, *[0] * len(names)) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
