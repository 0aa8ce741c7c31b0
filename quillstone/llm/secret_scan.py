"""Secret scan: fixed patterns, and a battery of randomness tests on unbroken runs, in DataFrame operations only.

A run of at least ``LEAST`` characters of the base64 alphabets is put to three tests of randomness in the encoding that
its characters allow (hexadecimal, base32 or base64): chi-squared for a uniform alphabet, runs above and below the
alphabet's middle, and serial correlation of neighbours. Fisher's rule joins the three p-values to one: how well the run
passes for random. What ordinary text does in the same test is a fixed table (``NULL``), so that it doesn't depend on which
words a corpus happens to hold, or on how many. Within each band of lengths the Benjamini-Hochberg rule finds, for the runs
with letters and digits, the lowest p-value at which no more than ``rate`` of the runs reported are expected to be ordinary.
Longer runs give sharper tests, so each band has its own threshold.

The corpus is read twice: once for a histogram of p-values by band, which is all that is shuffled or reaches the driver
(bands x bins), and once for the spans, which are found within the row.

Defined results. Null and empty texts have no spans. Repeated rows: one result each. Spans that start together are in
the order of their kinds. Texts are scanned whole. The table ends at a share of 1 in 5,000: in a band in which random runs
are less than 1 in 250 of those with letters and digits, they aren't told from ordinary ones. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import pick, text_or_empty

KINDS = ("assign", "access", "hex", "random")
#: The base patterns; the least lengths are asked of what they find.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
#: A whole run of 32 or more: the same as all runs of which shorter ones are dropped.
HEX = "[0-9a-f]{32,}"
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
BANDS = (20, 24, 32, 48, 64, 128)
BINS = 200
#: The p-values that these shares of ordinary runs reach, by band. Taken from 40,000 runs a band, each of the
#: band's least length, which pass for random most easily: words of A-Z from documents of sf0.1, every fifth replaced by a
#: number of one to four digits, joined by nothing, "-", "_" or "/", cut, those with letters and digits kept.
SHARES = (0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0002)
NULL = (
    (0.0267, 0.0722, 0.1329, 0.1982, 0.3273, 0.4365, 0.5206, 0.6231),
    (0.0025, 0.0114, 0.0275, 0.0541, 0.1117, 0.1631, 0.2197, 0.2994),
    (0.0001, 0.0001, 0.0003, 0.0012, 0.0052, 0.0117, 0.0216, 0.0567),
    *[(0.0001,) * 8] * 3,
)
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
SPAN = "STRUCT<kind:INT,s:BIGINT,e:BIGINT,x:STRING>"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(kind: int, pattern: str, group: int | None = None, least: int = 0) -> str:
    """SQL for the array of leftmost non-overlapping matches in ``text``, with their places in code points.

    Splitting by the pattern gives what lies between the matches; the lengths of both add up to the places.
    """
    p = quoted(pattern)
    value = f"regexp_extract_all(text, {p}, {group or 0})"
    return f"""filter(aggregate(
        zip_with(slice(split(text, {p}), 1, greatest(size(split(text, {p})) - 1, 0)), arrays_zip(regexp_extract_all(text, {p}, 0) AS m, {value} AS x),
                 (gap, z) -> named_struct('gap', CAST(length(gap) AS BIGINT), 'n', CAST(length(z.m) AS BIGINT), 'x', z.x)),
        named_struct('at', 0L, 'out', CAST(array() AS ARRAY<{SPAN}>)),
        (acc, z) -> named_struct('at', acc.at + z.gap + z.n, 'out', concat(acc.out, array(named_struct('kind', {kind}, 's', acc.at + z.gap, 'e', acc.at + z.gap + z.n, 'x', z.x)))),
        acc -> acc.out), z -> length(z.x) >= {least})""".replace(f"arrays_zip(regexp_extract_all(text, {p}, 0) AS m, {value} AS x)", f"zip_with(regexp_extract_all(text, {p}, 0), {value}, (m, x) -> named_struct('m', m, 'x', x))")


def erfc(x: str) -> str:
    """SQL for the complementary error function of x >= 0 (Abramowitz and Stegun 7.1.26)."""
    t = f"(1 / (1 + 0.3275911D * {x}))"
    return f"(((((1.061405429D * {t} - 1.453152027D) * {t} + 1.421413741D) * {t} - 0.284496736D) * {t} + 0.254829592D) * {t} * exp(-{x} * {x}))"


def battery(runs: str) -> str:
    """SQL from an array of spans to an array of (kind, s, e, x, band, mixed, p)."""
    bands = " ".join(f"WHEN n < {b} THEN {i}" for i, b in enumerate(BANDS[1:]))
    coded = f"""transform({runs}, z -> named_struct('z', z, 'x', rtrim('=', z.x),
        'alphabet', CASE WHEN z.x RLIKE '^[0-9a-f]+$' THEN '0123456789abcdef' WHEN z.x RLIKE '^[0-9A-F]+$' THEN '0123456789ABCDEF'
                         WHEN z.x RLIKE '^[A-Z2-7]+=*$' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' ELSE '{BASE64}' END))"""
    values = f"""transform({coded}, c -> named_struct('z', c.z, 'k', least(length(c.alphabet), 64), 'n', greatest(length(c.x), 2), 'x', c.x, 'alphabet', c.alphabet,
        'v', transform(split(replace(replace(c.x, '-', '+'), '_', '/'), ''), d -> CAST(instr(c.alphabet, d) - 1 AS DOUBLE))))"""
    sums = f"""transform({values}, c -> named_struct('z', c.z, 'x', c.x, 'k', c.k, 'n', c.n, 'v', c.v,
        'squares', aggregate(transform(split(c.alphabet, ''), a -> length(c.x) - length(replace(c.x, a, ''))), 0D, (sum, m) -> sum + CAST(m AS DOUBLE) * m),
        'high', CAST(size(filter(c.v, d -> d >= c.k / 2)) AS DOUBLE),
        'runs', 1D + size(filter(zip_with(slice(c.v, 2, greatest(size(c.v) - 1, 0)), slice(c.v, 1, greatest(size(c.v) - 1, 0)), (a, b) -> (a >= c.k / 2) <> (b >= c.k / 2)), d -> d)),
        'mean', aggregate(c.v, 0D, (sum, d) -> sum + d) / c.n))"""
    moments = f"""transform({sums}, c -> named_struct('z', c.z, 'x', c.x, 'k', c.k, 'n', CAST(c.n AS DOUBLE), 'runs', c.runs, 'chi', c.squares * c.k / c.n - c.n, 'pairs', 2D * c.high * (c.n - c.high),
        'spread', aggregate(c.v, 0D, (sum, d) -> sum + (d - c.mean) * (d - c.mean)),
        'joint', aggregate(zip_with(slice(c.v, 2, greatest(size(c.v) - 1, 0)), slice(c.v, 1, greatest(size(c.v) - 1, 0)), (a, b) -> (a - c.mean) * (b - c.mean)), 0D, (sum, d) -> sum + d)))"""
    scores = f"""transform({moments}, c -> named_struct('z', c.z, 'x', c.x, 'n', c.n,
        'uniform', (pow(c.chi / (c.k - 1), 1D / 3) - 1 + 2D / (9 * (c.k - 1))) / sqrt(2D / (9 * (c.k - 1))),
        'runs', CASE WHEN c.pairs * (c.pairs - c.n) <= 0 THEN 40D ELSE abs(c.runs - 1 - c.pairs / c.n) / sqrt(c.pairs * (c.pairs - c.n) / (c.n * c.n * (c.n - 1))) END,
        'serial', CASE WHEN c.spread <= 0 THEN 40D ELSE abs(c.joint / c.spread + 1 / c.n) * sqrt(c.n) END))"""
    # a uniform alphabet is tested one-sided, the other two two-sided
    ps = f"""transform({scores}, c -> named_struct('z', c.z, 'x', c.x, 'n', c.n, 'h',
        -ln(greatest(CASE WHEN c.uniform >= 0 THEN 0.5D * {erfc("(least(c.uniform, 36D) / sqrt(2D))")} ELSE 1 - 0.5D * {erfc("(least(-c.uniform, 36D) / sqrt(2D))")} END, 1e-300D))
        - ln(greatest({erfc("(least(c.runs, 36D) / sqrt(2D))")}, 1e-300D)) - ln(greatest({erfc("(least(c.serial, 36D) / sqrt(2D))")}, 1e-300D))))"""
    return f"""transform({ps}, c -> named_struct('kind', c.z.kind, 's', c.z.s, 'e', c.z.e, 'x', c.z.x, 'band', {f"CASE {bands} ELSE {len(BANDS) - 1} END".replace("WHEN n <", "WHEN c.n <")},
        'mixed', c.x RLIKE '[0-9]' AND c.x RLIKE '[A-Za-z]', 'p', exp(-c.h) * (1 + c.h + c.h * c.h / 2)))"""


def thresholds(docs: DataFrame, rate: float) -> list[float]:
    """For each band the lowest p-value that is reported; above 1 where none is."""
    tokens = docs.where(F.col("text").rlike(RUN)).select(F.expr(f"transform(regexp_extract_all(text, {quoted(RUN)}, 0), x -> named_struct('kind', 3, 's', 0L, 'e', 0L, 'x', x))").alias("runs"))
    tested = tokens.select(F.explode(F.expr(battery("runs"))).alias("t")).where("t.mixed")
    binned = tested.groupBy("t.band", F.expr(f"CAST(least(floor(t.p * {BINS}), {BINS - 1}) AS INT)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["band"], r["bin"]): r["n"] for r in binned.collect()}  # at most bands x bins
    found = []
    for band, reached in enumerate(NULL):
        mixed = [counts.get((band, b), 0) for b in range(BINS)]
        lowest, total, above = 2.0, sum(mixed), 0
        for b in range(BINS - 1, -1, -1):
            above += mixed[b]
            ordinary = min((share for share, p in zip(SHARES, reached, strict=True) if p <= b / BINS), default=1)
            if above and ordinary * total <= rate * above:
                lowest = b / BINS
        found.append(lowest)
    return found


def scan(docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and all: arrays of (kind, s, e, x), sorted; kind is an index of KINDS, x the run or value found."""
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty(F.col("text")))
    lowest = thresholds(src, rate)
    none = f"CAST(array() AS ARRAY<{SPAN}>)"
    limit = "CASE t.band " + " ".join(f"WHEN {i} THEN {p}D" for i, p in enumerate(lowest)) + " END"
    based = src.select("doc_id", "text", F.expr(f"""array_sort(concat(
        CASE WHEN text RLIKE '(?i:password|passwd|secret|token|api_?key)' THEN {spans(0, ASSIGN, 2, 8)} ELSE {none} END,
        CASE WHEN contains(text, 'AKIA') THEN {spans(1, ACCESS, None, 16)} ELSE {none} END,
        CASE WHEN text RLIKE '{HEX}' THEN {spans(2, HEX)} ELSE {none} END), {BY_START})""").alias("base"))  # fmt: skip
    tested = based.withColumn("tested", F.expr(f"CASE WHEN text RLIKE {quoted(RUN)} THEN {battery(spans(3, RUN))} END"))
    more = F.expr(f"transform(filter(coalesce(tested, array()), t -> t.mixed AND t.p >= {limit} AND NOT exists(base, b -> b.s < t.e AND t.s < b.e)), t -> named_struct('kind', t.kind, 's', t.s, 'e', t.e, 'x', t.x))")
    return tested.withColumn("more", more).select("doc_id", "text", "base", F.expr(f"array_sort(concat(base, more), {BY_START})").alias("all"))


BY_START = "(a, b) -> CASE WHEN a.s < b.s THEN -1 WHEN a.s > b.s THEN 1 WHEN a.kind < b.kind THEN -1 WHEN a.kind > b.kind THEN 1 ELSE 0 END"


def listed(column: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({column}, z -> concat(array({names})[z.kind], ':', z.s, ':', z.e)), ',')"


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    counts = [F.expr(f"CAST(size(filter(base, z -> z.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return scanned.select("doc_id", *counts, F.sha2(F.expr(listed("base")), 256).alias("base_sha256"), F.expr(listed("all")).alias("spans"))


def redacted(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """doc_id, text with every span replaced by the mask; overlapping spans share one."""
    parts = f"""aggregate(`all`, named_struct('at', 0L, 'out', ''), (acc, z) -> CASE WHEN z.s < acc.at THEN named_struct('at', greatest(acc.at, z.e), 'out', acc.out)
        ELSE named_struct('at', z.e, 'out', concat(acc.out, substring(text, CAST(acc.at + 1 AS INT), CAST(z.s - acc.at AS INT)), '{mask}')) END,
        acc -> concat(acc.out, substring(text, CAST(acc.at + 1 AS INT))))"""
    return scanned.select("doc_id", F.expr(f"CASE WHEN size(`all`) = 0 THEN text ELSE {parts} END").alias("text"))


def without_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, rate: float = 0.05) -> DataFrame:
    """The rows, columns as they are but for the text, masked where it has spans, and its length if a column holds it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    masked = redacted(scan(rows, rate, "row", "text"))
    new = {text_col: F.when(F.col(f"doc_id.`{text_col}`").isNotNull(), F.col("text"))}
    if length_col:
        new[length_col] = F.when(F.col("text") == F.coalesce(F.col(f"doc_id.`{text_col}`"), F.lit("")), F.col(f"doc_id.`{length_col}`")).otherwise(F.length("text")).cast(docs.schema[length_col].dataType)
    return masked.select(*[new.get(c, F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])
