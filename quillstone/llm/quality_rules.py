"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a rejecting condition over a text's measures. What a rule costs, its measures included, and how much it rejects
is estimated on a sample drawn over the whole table; the cascade asks the rules in the order of rejection per cost. Costs are
counted, not timed: characters that a measure touches in the sample's texts, with an element of an array counted as the
characters that are handled in the same time. The same sample gives the same order on any machine. A text that
a rule has rejected is asked nothing more: a measure that only later rules need isn't computed for it. The order changes
what a text costs, never its verdict, for a text is kept only if no rule rejects it.

Repeated three-word windows, the dear measure, are found within the row: the hashes of the windows, with their positions in
the low bits, are sorted as numbers, and windows may repeat where neighbours in that order have the same high bits. Their
words are compared; in a text in which any two such neighbours differ, as happens among millions of words, the windows are
sorted as strings instead. That is n log n in the words of a text, with no row for each word.

Defined results. Null and empty texts and texts of white space have no words; they fail the base rule. Repeated rows:
one result each. Ties in rejection per cost go by cost, then by the rule's name. Texts are measured whole. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import pick, text_or_empty

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str
    """SQL condition over measures."""


#: The contract's own rules, then the method's.
BASE = (Rule("few_words", "n_words < 50"), Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"))
RULES = (
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("few_different_words", "100 * n_different < 20 * n_words"),
    Rule("repeated_lines", "n_lines >= 6 AND 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)


def left_out(chars: str) -> str:
    """SQL for the text's length without these characters."""
    plain = chars.replace("\\", "\\\\").replace("'", "\\'")
    return f"length(translate(text, '{plain}', ''))"


#: SQL for each measure over ``text`` and the measures before it.
MEASURES = {
    "words": f"array_remove(split(text, '{SPACE.replace(chr(92), chr(92) * 2)}'), '')",
    "n_words": "CAST(size(words) AS BIGINT)",
    "word_chars": f"CAST({left_out(SPACES)} AS BIGINT)",
    "n_symbols": f"CAST(length(text) - {left_out(SYMBOLS)} AS BIGINT)",
    "n_capitals": f"length(text) - {left_out(UPPER)}",
    "n_different": "size(array_distinct(words))",
    "lines": f"filter(split(text, '\n'), line -> translate(line, '{SPACES}', '') <> '')",
    "n_lines": "CAST(size(lines) AS BIGINT)",
    "n_dup_lines": "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)",
    "place_bits": "CAST(length(bin(size(words))) AS INT)",
    # the high bits are a window's hash, the low ones its position
    "coded": "sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> shiftleft(xxhash64(w, words[i + 1], words[i + 2]), place_bits) | CAST(i AS BIGINT)))",
    "twins": """CASE WHEN size(coded) < 2 THEN CAST(array() AS ARRAY<STRUCT<a:INT,b:INT>>) ELSE transform(
        filter(sequence(1, size(coded) - 1), i -> shiftright(coded[i - 1], place_bits) = shiftright(coded[i], place_bits)),
        i -> named_struct('a', CAST(coded[i - 1] & (shiftleft(1L, place_bits) - 1) AS INT), 'b', CAST(coded[i] & (shiftleft(1L, place_bits) - 1) AS INT))) END""",
    "repeated": """CASE WHEN forall(twins, t -> words[t.a] = words[t.b] AND words[t.a + 1] = words[t.b + 1] AND words[t.a + 2] = words[t.b + 2])
        THEN sort_array(array_distinct(concat(transform(twins, t -> t.a), transform(twins, t -> t.b))))
        ELSE transform(array(array_sort(transform(sequence(0, size(words) - 3), i -> named_struct('w', concat_ws(' ', words[i], words[i + 1], words[i + 2]), 'i', i)))),
            strings -> sort_array(transform(filter(sequence(0, size(strings) - 1), k -> (k > 0 AND strings[greatest(k - 1, 0)].w = strings[k].w)
                OR (k < size(strings) - 1 AND strings[least(k + 1, size(strings) - 1)].w = strings[k].w)), k -> strings[k].i)))[0] END""",
    "n_repeat_words": """CASE WHEN size(repeated) = 0 THEN 0L ELSE aggregate(zip_with(slice(repeated, 2, size(repeated) - 1), slice(repeated, 1, size(repeated) - 1), (x, y) -> least(x - y, 3)),
        3L, (sum, x) -> sum + x) END""",
}


#: SQL for the characters that making a measure touches. A hash of a word, or a place in an array, counts as ``ELEMENT`` characters.
ELEMENT = 16
TOUCHED = {
    "words": f"length(text) + {ELEMENT} * size(words)",
    "n_words": "1",
    "word_chars": "length(text)",
    "n_symbols": "length(text)",
    "n_capitals": "length(text)",
    "n_different": f"length(text) + {ELEMENT} * size(words)",
    "lines": f"2 * length(text) + {ELEMENT} * size(lines)",
    "n_lines": "1",
    "n_dup_lines": f"length(text) + {ELEMENT} * size(lines)",
    "place_bits": "1",
    "coded": f"3 * length(text) + {ELEMENT} * size(words) * (1 + log2(1 + size(words)))",
    "twins": f"{ELEMENT} * size(words)",
    "repeated": f"{ELEMENT} * size(twins) * (1 + log2(1 + size(twins)))",
    "n_repeat_words": f"{ELEMENT} * size(repeated)",
}
#: What the cascade has anyway: rules don't pay for it.
SHARED = ("words", "n_words")


def steps_of(condition: str) -> list[str]:
    """The measures that a condition needs, each after those that it needs itself."""
    found: list[str] = []
    for name in MEASURES:
        if re.search(rf"\b{name}\b", condition):
            found += [*steps_of(MEASURES[name]), name]
    return list(dict.fromkeys(found))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` may be a struct of the row, if its other columns are to come along."""
    return pick(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty(F.col("text")))


def measured(texts: DataFrame, names: list[str], only: str = "") -> DataFrame:
    """With these measures where they aren't columns yet; for rows of which the condition ``only`` doesn't hold they are null."""
    for name in names:
        if name not in texts.columns:
            texts = texts.withColumn(name, F.expr(f"CASE WHEN {only} THEN {MEASURES[name]} END" if only else MEASURES[name]))
    return texts


def judged(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """With rejected_by: the first rule of the cascade that rejects the text; what only later ones need isn't computed for it."""
    for k, rule in enumerate(rules):
        texts = measured(texts, steps_of(rule.rejects), "rejected_by IS NULL" if k else "")
        verdict = f"CASE WHEN {rule.rejects} THEN '{rule.name}' END"
        texts = texts.withColumn("rejected_by", F.expr(f"CASE WHEN rejected_by IS NULL THEN {verdict} ELSE rejected_by END" if k else verdict))
    return texts


def estimates(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample_rows: int) -> dict[str, tuple[int, float]]:
    """For each rule how many of about ``sample_rows`` texts, drawn over all rows, it rejects, and the characters that it touches; one job, one row."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    texts = docs.select(text_or_empty(F.col(f"`{text_col}`")).alias("text")).sample(share, seed=7)
    needed = {rule.name: steps_of(rule.rejects) for rule in rules}
    known = measured(texts, list(dict.fromkeys(["words", "n_words", *[step for steps in needed.values() for step in steps]])))
    sums = []
    for k, rule in enumerate(rules):
        touched = [f"CAST({TOUCHED[step]} AS DOUBLE)" for step in needed[rule.name] if step not in SHARED]
        sums += [F.count_if(F.expr(rule.rejects)).alias(f"rejected_{k}"), F.sum(F.expr(" + ".join(touched) or "0D") + 1).alias(f"touched_{k}")]
    row = known.agg(*sums).first()
    return {rule.name: (row[f"rejected_{k}"], row[f"touched_{k}"] or 1.0) for k, rule in enumerate(rules)}


def ordered_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = 300) -> list[Rule]:
    """The rules by rejection per cost; of those that reject nothing in the sample the cheaper ones come first."""
    found = estimates(docs, text_col, rules, sample_rows)

    def place(rule: Rule) -> tuple[float, float, str]:
        rejected, cost = found[rule.name]
        return -rejected / cost, cost, rule.name

    return sorted(rules, key=place)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 300) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The measures that are returned are those of every text; the cascade saves those that only the method's rules need.
    """
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    known = measured(texts_of(docs, id_col, text_col), list(dict.fromkeys(step for name in shown for step in steps_of(name))))
    failed = " OR ".join(f"({rule.rejects})" for rule in BASE)
    out = judged(known, ordered_rules(docs, text_col, BASE + rules, sample_rows))
    return out.select("doc_id", *shown, F.expr(failed).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def without_rejected(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = 300) -> DataFrame:
    """The rows, all columns as they are, that the cascade keeps; nothing is shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    out = judged(texts_of(rows, "row", "text"), ordered_rules(docs, text_col, rules, sample_rows))
    # a filter would be pushed below the measures, each of them spelled out wherever it is used; it stays above a column
    # that isn't deterministic, although this one is always true
    return out.select("doc_id", F.when(F.monotonically_increasing_id() >= 0, F.col("rejected_by").isNull()).alias("kept")).where("kept").select("doc_id.*")


QUALITY_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
v AS (SELECT doc_id, text, words, lines, len(words) AS n, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars FROM w),
g AS (SELECT doc_id, unnest(list_transform(range(1, n - 1), lambda i: {{'i': i, 'w': words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2]}})) AS x FROM v WHERE n >= 3),
r AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.w) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT k) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT v.doc_id, n AS n_words, word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, len(list_distinct(words)) AS n_different,
         length(text) - length(translate(text, '{UPPER}', '')) AS n_upper
  FROM v LEFT JOIN p ON v.doc_id IS NOT DISTINCT FROM p.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_upper > 40 * word_chars OR 100 * n_different < 20 * n_words
            OR (n_lines >= 6 AND 2 * n_dup_lines > n_lines) OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM f
"""
