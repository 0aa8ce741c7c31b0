
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence terminators of the two profiles.
TERMINATORS = {"v1": ".!?।॥۔؟。！？", "v2": ".!?।॥۔؟。！？…"}
#: Abbreviations that don't end a sentence (v1 compares the last word, v2 is a pattern).
ABBREVIATIONS_V1 = "mr mrs ms dr prof sr jr st vs etc inc ltd co corp no vol fig eg ie approx dept est min max avg".split()
ABBREVIATIONS_V2 = r"[A-Z]|Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|Rev|Hon|vs|etc|Inc|Ltd|Co|Corp|e\.g|i\.e|a\.m|p\.m|U\.S|U\.K|No"
#: Fixed value: v1 glues shorter parts to what stands before them.
SHORT_V1 = 15
#: Code point ranges that vote for a language.
SCRIPTS = (
    ("hi", "0900", "097F"),
    ("bn", "0980", "09FF"),
    ("pa", "0A00", "0A7F"),
    ("gu", "0A80", "0AFF"),
    ("or", "0B00", "0B7F"),
    ("ta", "0B80", "0BFF"),
    ("te", "0C00", "0C7F"),
    ("kn", "0C80", "0CFF"),
    ("ml", "0D00", "0D7F"),
    ("ur", "0600", "06FF"),
)
#: Characters that can't be seen.
INVISIBLE = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\uFEFF]"
TOKEN = "[\\p{L}\\p{N}_]+"
#: The same class in the standard library's syntax.
WORD = re.compile(r"\w+")
GAP = "[^\\p{L}\\p{N}_]"


#: Rows whose values a function holds as Python objects at a time.
ROWS = 256
KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}


def by_rows(each: Callable, kind: str) -> Callable[..., Column]:
    """A column function from one that makes a row's value of its arguments; made when it is used, for it needs a session.

    Texts come and go in Arrow's buffers; Python objects are made of ``ROWS`` of them at a time, so a task's Python holds as much
    of a large table as of a small one, whatever number of rows Spark puts into a batch.
    """
    rows, arrow = ROWS, KINDS[kind]

    def run(*columns: pa.Array) -> pa.Array:
        parts = [pa.array([each(*row) for row in zip(*(c.slice(k, rows).to_pylist() for c in columns), strict=True)], arrow) for k in range(0, len(columns[0]), rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return F.arrow_udf(run, kind)


def _unicode(form: str) -> Callable[[Column], Column]:
    return by_rows(lambda t: None if t is None else unicodedata.normalize(form, t), "string")


def nfc(text: Column) -> Column:
    """Canonical composition, which Spark has no function for: an Arrow batch at a time. Plain ASCII isn't sent there."""
    return F.coalesce(_unicode("NFC")(F.when(~text.rlike("^[\\x00-\\x7F]*$"), text)), text)


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?U)\\s+", " "), "^ | $", "")


def normalize(text: Column, profile: str = "v2") -> Column:
    """NFC, white space collapsed; v2 also drops zero-width spaces and byte order marks. Null: empty.

    All of it in one Arrow function: Spark has none for the composition, and on 25 MB of documents in four languages the rest
    as regular expressions over its result took three times as long.
    """
    normalized = by_rows(lambda t: plain(t, profile), "string")
    # as one that isn't deterministic it is called once, where a filter on its result would have Spark call it twice
    return normalized.asNondeterministic()(F.coalesce(text, F.lit("")))


def plain(text: str, profile: str) -> str:
    """A text as ``normalize`` makes it."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = text.replace("\u200b", "").replace("\ufeff", "") if profile == "v2" else text
    return " ".join(text.split())


def normalize_each(texts: Column, profile: str = "v2") -> Column:
    """The same for every text of an array."""
    return by_rows(lambda own: None if own is None else [plain(t or "", profile) for t in own], "array<string>")(texts)


def folded(text: Column) -> Column:
    """Without invisible characters, compatibility forms as the characters they stand for. Plain ASCII isn't sent to Python."""
    seen = F.regexp_replace(text, INVISIBLE, "")
    return F.coalesce(_unicode("NFKC")(F.when(~seen.rlike("^[\\x00-\\x7F]*$"), seen)), seen)


def sanitize(text: Column) -> Column:
    return F.trim(folded(text))


def invisible_removed(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, INVISIBLE, ""))).cast("long")


def doc_hash(normalized: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.lower(normalized), 256), 1, length)


def point_id(chunk_id: Column) -> Column:
    """First 8 bytes of SHA-256, big-endian, without the lowest bit: a 63-bit number."""
    return F.floor(F.conv(F.substring(F.sha2(chunk_id, 256), 1, 16), 16, 10).cast("decimal(20,0)") / 2).cast("bigint")


def estimate_tokens(text: Column) -> Column:
    n = F.length(text)
    foreign = F.length(F.regexp_replace(text, "[\\x00-\\x7F]++", ""))  # by runs: one by one, each character is a match
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.when(foreign > n * 0.3, 2.5).otherwise(4.0)))).cast("long")


def script_lang(text: Column) -> Column:
    """The language whose script has most characters; the one that comes first in the text wins a tie; v2 counts any letter below U+0590 for en."""
    latin = "[\\p{L}&&[\\u0000-\\u058F]]"
    removed = lambda t, chars: F.length(t) - F.length(F.regexp_replace(t, f"{chars}++", ""))
    # most texts have no other script: its characters are taken out in one pass, and only they are told apart
    other = F.regexp_replace(text, f"[^{''.join(f'\\u{low}-\\u{high}' for _, low, high in SCRIPTS)}]++", "")

    def vote(n: Column, before: str, lang: str) -> Column:
        return F.struct(n.alias("n"), F.when(n > 0, -F.length(F.regexp_extract(text, f"(?s)^({before})", 1))).otherwise(0).alias("first"), F.lit(lang).alias("lang"))

    def best(seen: Column) -> Column:
        votes = [vote(seen["en"], f"(?:(?!{latin}).)*+", "en"), *[vote(removed(seen["other"], f"[\\u{low}-\\u{high}]"), f"[^\\u{low}-\\u{high}]*+", lang) for lang, low, high in SCRIPTS]]
        return F.array_max(F.array(*votes))

    # as an array of one, so that what is found of a text is made once, however often it is looked at
    found = F.transform(F.transform(F.array(F.struct(removed(text, latin).alias("en"), other.alias("other"))), best), lambda v: F.when(v["n"] > 0, v["lang"]).otherwise("en"))
    return F.get(found, F.lit(0))


def raw_sentences(normalized: Column, profile: str = "v2") -> Column:
    """Parts after a terminator and white space, before abbreviations are joined."""
    return F.filter(F.split(normalized, f"(?<=[{TERMINATORS[profile]}])\\s+"), lambda s: s != "")


def split_sentences(normalized: Column, profile: str = "v2") -> Column:
    """Sentences of a normalized text, by one split: look-arounds say where a part is glued to the one before it.

    v2 glues after an abbreviation and drops sentences under 2 characters; v1 glues after a word of its list and parts under
    15 characters, and folds a first sentence under 15 forward.
    """
    ends = f"(?<=[{TERMINATORS[profile]}])"
    if profile == "v2":
        parts = F.split(normalized, f"{ends}(?<!(?iU:\\b(?:{ABBREVIATIONS_V2})\\.))\\s+")
        return F.filter(parts, lambda s: F.length(s) >= 2)
    words = "|".join(ABBREVIATIONS_V1)
    long = f"(?=(?:(?![{TERMINATORS[profile]}]\\s)(?s:.)){{{SHORT_V1 - 1}}}(?s:.))"
    merged = F.filter(F.split(normalized, f"{ends}(?<!(?iu:(?:^|\\s)\\.{{0,9}}(?:{words})\\.{{0,9}}\\s?\\.))\\s+{long}"), lambda s: s != "")
    folded = F.concat(F.array(F.concat_ws(" ", F.get(merged, F.lit(0)), F.get(merged, F.lit(1)))), F.slice(merged, F.lit(3), F.greatest(F.size(merged) - 2, F.lit(0))))
    return F.when((F.size(merged) > 1) & (F.length(F.get(merged, F.lit(0))) < SHORT_V1), folded).otherwise(merged)


def split_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\\n\\s*\\n+"), collapse), lambda p: p != "")


def truncate_to_chars(text: Column, limit: int) -> Column:
    """At a word's end if the last space is past 80 % of the limit, with an ellipsis."""
    cut = F.substring(text, 1, limit)
    last = F.when(F.instr(cut, " ") > 0, F.length(cut) - F.instr(F.reverse(cut), " ")).otherwise(-1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.when(last > limit * 0.8, F.substring(cut, F.lit(1), last)).otherwise(cut)), F.lit("…")))


def clean_for_speech(text: Column) -> Column:
    """Markdown stripped."""
    for pattern, kept in (("\\*\\*(.+?)\\*\\*", "$1"), ("\\*(.+?)\\*", "$1"), ("`(.+?)`", "$1"), ("\\[(.+?)\\]\\(.+?\\)", "$1"), ("(?m)^\\s*[-*+]\\s+", ""), ("(?m)^\\s*#+\\s*", "")):
        text = F.regexp_replace(text, pattern, kept)
    return collapse(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def count_tokens(text: Column) -> Column:
    """As an embedding model counts: with the two that frame its input."""
    return n_tokens(text) + 2


def token_slices(text: Column, n: Column | int) -> Column:
    """The text from its first token on, in slices of n tokens, each with what stands between it and the next one."""
    pattern = F.concat(F.lit(f"(?:{TOKEN}+{GAP}*+){{1,"), F.lit(n).cast("string") if isinstance(n, int) else n.cast("string"), F.lit("}+"))
    return F.regexp_extract_all(text, pattern, F.lit(0))


def without_tail(text: Column) -> Column:
    """Up to the end of the last token."""
    return F.regexp_replace(text, f"{GAP}+$", "")


def within_limit(text: Column, limit: Column | int) -> Column:
    """The text itself if a model takes it, else slices of it, each of so many tokens at most, from a token's first character to a token's last."""
    return F.when(count_tokens(text) <= limit, F.array(text)).otherwise(F.when(n_tokens(text) == 0, F.array(text)).otherwise(F.transform(token_slices(text, limit), without_tail)))


def counted(text: str) -> int:
    """``count_tokens`` of one text."""
    return len(WORD.findall(text)) + 2


def limited(text: str, limit: int, size: int | None = None) -> list[str]:
    """``within_limit`` of one text, whose size may be known."""
    if (counted(text) if size is None else size) <= limit:
        return [text]
    spans = [m.span() for m in WORD.finditer(text)]
    return [text[spans[k][0] : spans[min(k + limit, len(spans)) - 1][1]] for k in range(0, len(spans), limit)] or [text]


def token_offsets(text: Column) -> Column:
    """start and end, in characters, of each token."""
    return by_rows(lambda t: None if t is None else [{"start": m.start(), "end": m.end()} for m in WORD.finditer(t)], "array<struct<start:int,end:int>>")(text)
