"""Around generation: guards, confidence, context budget, citations, groundedness, JSON repair, breaker and failover replay."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vectors as V

#: Input patterns of the two profiles.
INJECTION_V2 = (
    r"(ignore|disregard|forget)\s+(all\s+|any\s+|the\s+|your\s+|previous\s+|prior\s+|above\s+)*(instruction|prompt|rule|direction|context)"
    r"|you\s+are\s+now\s+(a|an|no\s+longer)|(reveal|show|print|repeat|output)\s+(me\s+)?(your|the)\s+(system\s+)?(prompt|instruction)"
    r"|<\s*/?\s*(system|assistant|user)\s*>|\bDAN\b|jailbreak|act\s+as\s+(if\s+you\s+are\s+)?an?\s+(unrestricted|unfiltered|uncensored)"
)
UNSAFE_V2 = (
    r"how\s+(to|do\s+i|can\s+i)\s+.{0,30}\b(make|build|synthesize|acquire)\b.{0,30}\b(bomb|explosive|meth|methamphetamine|nerve\s+agent|ricin|sarin|napalm)\b"
    r"|how\s+(to|do\s+i|can\s+i)\s+.{0,40}\b(kill|murder|poison|harm)\b\s+(someone|a\s+person|my|him|her|them)"
    r"|\b(child\s+porn|csam)\b|how\s+to\s+.{0,30}\b(hack|ddos|breach)\b.{0,20}\b(bank|hospital|government|someone)"
)
INJECTION_V1 = (
    r"\bignore\s+(all\s+|any\s+|the\s+)?(previous|prior|above|earlier)\b|\bdisregard\s+(all\s+|any\s+|the\s+)?(previous|prior|above|instructions)\b"
    r"|\bforget\s+(everything|all|your)\s+(you|instructions|rules|above)\b|\byou\s+are\s+now\s+(a|an|no longer)\b"
    r"|\bact\s+as\s+(if\s+you|a|an)\b.{0,40}\b(unrestricted|jailbroken|dan)\b|\b(reveal|show|print|repeat|output)\s+(your|the)\s+(system\s+)?(prompt|instructions|rules)\b"
    r"|\bsystem\s*[:>]\s*|<\s*/?\s*(system|instruction|prompt)\s*>|\b(developer|admin|root)\s+mode\b|\bbypass\s+(all\s+)?(your\s+)?(safety|filter|guardrail|restriction)"
)
UNSAFE_V1 = (
    r"\bhow\s+to\s+(make|build|synthesize|construct)\s+(a\s+)?(bomb|explosive|weapon|nerve\s+agent|bioweapon)|\b(synthesize|manufacture)\s+(meth|methamphetamine|fentanyl|ricin|sarin)\b"
    r"|\bhow\s+to\s+(kill|murder|poison)\s+(someone|a\s+person|people|my)\b|\b(child|minor|underage)\s+(porn|sexual|abuse\s+material)\b|\bhow\s+to\s+(hack|breach|ddos)\s+.{0,30}\b(without\s+permission|illegally)\b"
)
META_V1 = (
    r"^\s*(hi|hello|hey|namaste|नमस्ते|hola)\b[\s!.?]*$|\bwhat\s+(model|llm|ai)\s+are\s+you\b|\bwho\s+(made|built|created|trained)\s+you\b|\bare\s+you\s+(chatgpt|claude|gemini|gpt|an?\s+ai|human|real)\b"
    r"|\b(write|generate|compose)\s+(me\s+)?(a\s+)?(poem|song|story|essay|code|script|program)\b|\b(translate|summarize)\s+this\b"
)
ADVICE_V1 = r"\b(should|shall)\s+i\s+(invest|buy|sell|take|quit|marry|divorce)\b|\bdiagnose\s+(my|me)\b|\bwhat('?s|\s+is)\s+wrong\s+with\s+(me|my)\b|\b(my|our)\s+(lawyer|doctor|symptoms)\b.{0,40}\bshould\s+i\b"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iu){pattern}")


def guard_input_v2(text: Column) -> Column:
    """The refusal reason, or PASS; the first guard that fails says it."""
    return F.when(F.length(F.trim(text)) < 2, "UNSAFE_INPUT").when(matches(F.trim(text), INJECTION_V2), "PROMPT_INJECTION").when(matches(text, UNSAFE_V2), "UNSAFE_INPUT").otherwise("PASS")


def guard_input_v1(text: Column, most: int = 1000) -> Column:
    """Length and patterns are of the text without invisible characters and compatibility forms; where nothing blocks, hidden characters warn. Null is empty."""
    seen = T.folded(text)
    return (
        F.when(text.isNull() | text.rlike("(?U)^[\\s\\x1C-\\x1F]*$"), "block:empty")
        .when(F.length(seen) > most, "block:too_long")
        .when(matches(seen, UNSAFE_V1), "block:unsafe_content")
        .when(matches(seen, INJECTION_V1), "block:prompt_injection")
        .when(T.invisible_removed(text) > 0, "warn:invisible")
        .otherwise("pass")
    )


def guard_offtopic_v1(text: Column) -> Column:
    return F.when(matches(text, META_V1), "block:meta").when(matches(text, ADVICE_V1), "block:advice").when(F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) < 2, "warn:short").otherwise("pass")


def confidence_v2(top: Column, flatness: Column, n: Column, tau: float = 0.72, least: float = 1.04) -> Column:
    """A null flatness is endless; no candidates refuse."""
    return F.when(n == 0, "refuse:none").when(top < tau, "refuse:low").when(F.coalesce(flatness, F.lit(1e9)) < least, "refuse:flat").otherwise("pass")


def confidence_v1(scores: Column, tau: float = 0.35, least: int = 1) -> Column:
    """Of the final scores in rank order: block if fewer than ``least`` reach tau, warn if the first is under 1.4 tau."""
    return F.when(F.size(F.filter(scores, lambda s: s >= tau)) < least, "block").when(F.get(scores, F.lit(0)) < 1.4 * tau, "warn").otherwise("pass")


def confidence_details(scores: Column, tau: float = 0.35) -> Column:
    """What the guard tells of its verdict: numbers of passages, the first score and the first five."""
    rounded = F.transform(F.slice(scores, 1, 5), lambda s: F.round(s, 4))
    return F.struct(F.size(scores).alias("retrieved"), F.size(F.filter(scores, lambda s: s >= tau)).alias("above"), F.round(F.get(scores, F.lit(0)), 4).alias("top_score"), rounded.alias("distribution"))


def context_budget(ranked: DataFrame, budget: int = 6000) -> DataFrame:
    """Passages of (qid, rank, text) up to the first that overflows the budget of characters; the first always stays."""
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("chars_upto", F.sum(F.length("text")).over(upto)).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where((F.col("chars_upto") <= budget) | (F.col("place") == 1)).drop("place")


def citations(cited: Column, available: Column) -> Column:
    """Refuse if all cited ids are unknown, strip if some are; ratio 1 if none is cited."""
    valid = F.filter(cited, lambda c: F.array_contains(available, c))
    verdict = F.when(F.size(cited) == 0, "pass").when(F.size(valid) == 0, "refuse").when(F.size(valid) < F.size(cited), "strip").otherwise("pass")
    return F.struct(valid.alias("valid"), verdict.alias("verdict"), F.when(F.size(cited) == 0, 1.0).otherwise(F.size(valid) / F.size(cited)).alias("ratio"))


#: What an answer says that asserts nothing.
HEDGES = (
    "i don't know", "i do not know", "not enough information", "cannot determine", "no information", "does not contain", "unable to answer", "not mentioned", "insufficient", "पर्याप्त नहीं", "जानकारी नहीं",
)
MARKER = r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]"
NUMBER = r"(?U)\b\d[\d,.\-/]*\b"


def hedged(answer: Column) -> Column:
    return F.exists(F.array(*map(F.lit, HEDGES)), lambda m: F.contains(F.lower(answer), m))


def numbers_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, MARKER, " ")), F.lit(NUMBER), F.lit(0)))


def claim_tokens(text: Column) -> Column:
    """Distinct numbers and words without [n] markers; Latin words of up to 3 letters don't count."""
    words = F.array_distinct(T.tokens(F.regexp_replace(text, MARKER, " ")))
    return F.array_union(numbers_of(text), F.filter(words, lambda w: ~w.rlike(r"^[\x00-\x7F]{1,3}$")))


def overlap(claim: Column, numbers: Column, passage: Column) -> Column:
    """Weighted share of a claim's tokens that the passage holds; numbers weigh 2."""
    weight = lambda tokens: F.size(tokens) + F.size(F.array_intersect(tokens, numbers))
    return F.when(F.size(claim) > 0, weight(F.array_intersect(claim, passage)) / weight(claim)).otherwise(0.0)


#: Fixed value: passages that a claim names as its support at most.
SUPPORTING = 3


def passage_sets(passages: Column) -> Column:
    """The claim tokens of each passage, which is normalized as answers are before they are split."""
    return F.transform(T.normalize_each(passages, "v1"), claim_tokens)


def grounding_v1(answers: DataFrame, tau: float = 0.35, ids: str | None = None) -> DataFrame:
    """For (aid, claim, passages array<string>): score, the best overlap, and whether a passage reaches tau and has all of the claim's numbers.

    ``supporting`` has the first such passages: their places, from 0, or what the array column ``ids`` has there.

    A passage that lacks one of them counts for 0.9 tau at most. Claims without tokens aren't claims. Where several claims share
    their passages, the column ``passage_sets`` (the function of this name) stands for ``passages``, so that texts are normalized once.
    """
    known = answers if "passage_sets" in answers.columns else answers.withColumn("passage_sets", passage_sets(F.col("passages")))
    sets = known.withColumns({"claim_set": claim_tokens(F.col("claim")), "numbers": numbers_of(F.col("claim"))}).where(F.size("claim_set") > 0)
    each = F.transform("passage_sets", lambda p: F.struct(overlap(F.col("claim_set"), F.col("numbers"), p).alias("raw"), (F.size(F.array_except("numbers", p)) > 0).alias("missing")))
    scored = sets.withColumn("each", each)
    best = F.coalesce(F.array_max(F.transform("each", lambda e: F.when(e["missing"], F.least(e["raw"], F.lit(0.9 * tau))).otherwise(e["raw"]))), F.lit(0.0))
    holds = lambda e: (e["raw"] >= tau) & ~e["missing"]
    places = F.slice(F.filter(F.transform("each", lambda e, i: F.when(holds(e), i)), lambda i: i.isNotNull()), 1, SUPPORTING)
    named = F.transform(places, lambda i: F.get(F.col(ids), i)) if ids else places
    return scored.select("aid", "claim", F.round(best, 4).alias("score"), F.exists("each", holds).alias("supported"), named.alias("supporting"))


def grounded_v1(answers: DataFrame, tau: float = 0.35, least: float = 0.5) -> DataFrame:
    """For (aid, answer, passages): verdict, ratio, n_claims, supported, and the first three unsupported claims, of 120 characters each.

    An empty answer and one without context are blocked, one that declines passes, one without claims is warned of; else the
    share of supported claims decides.
    """
    # texts are normalized once an answer, before there is a row for each claim
    known = answers.where(F.trim("answer") != "").select("aid", passage_sets(F.col("passages")).alias("passage_sets"), T.normalize(F.col("answer"), "v1").alias("answer"))
    claims = known.select("aid", "passage_sets", F.posexplode(T.split_sentences(F.col("answer"), "v1")).alias("i", "claim"))
    judged = grounding_v1(claims.withColumn("aid", F.struct("aid", "i")), tau)
    sums = judged.groupBy(F.col("aid.aid").alias("aid")).agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if("supported").alias("supported"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(~F.col("supported"), F.struct("aid.i", F.substring("claim", 1, 120).alias("claim"))))), 1, 3), lambda c: c["claim"]).alias("unsupported"),
    )
    joined = answers.join(sums, "aid", "left").withColumn("share", F.col("supported") / F.col("n_claims"))
    verdict = (
        F.when(F.trim("answer") == "", "block:empty").when(hedged(F.col("answer")), "pass:hedge").when(F.size("passages") == 0, "block:no_context").when(F.col("n_claims").isNull(), "warn:no_claims")
        .when(F.col("share") < least, "block").when(F.col("share") < 1, "warn").otherwise("pass")
    )
    ratio = F.when(verdict == "pass:hedge", 1.0).when(verdict == "block:no_context", 0.0).otherwise(F.round("share", 4))
    return joined.select("aid", verdict.alias("verdict"), ratio.alias("ratio"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("supported", F.lit(0)).alias("supported"), F.coalesce("unsupported", F.array().cast("array<string>")).alias("unsupported"))


def grounding_v2(sentences: DataFrame, tau: float = 0.55, refuse: float = 0.60, warn: float = 0.85) -> DataFrame:
    """For (aid, sentence, embedding, contexts array<array<double>>): share of sentences over 15 characters whose best cosine reaches tau.

    None to verify passes with 1. One row an answer.
    """
    best = F.coalesce(F.array_max(F.transform("contexts", lambda c: V.dot(F.col("embedding"), c))), F.lit(0.0))
    long = F.length("sentence") > 15
    each = sentences.groupBy("aid").agg(F.count_if(long).alias("n"), F.count_if(long & (best >= tau)).alias("supported"))
    ratio = F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.col("supported") / F.col("n"), 6))
    return each.withColumn("ratio", ratio).withColumn("verdict", F.when(F.col("ratio") < refuse, "refuse").when(F.col("ratio") < warn, "warn").otherwise("pass"))


def composed_v2(verdicts: dict[str, Column], reasons: dict[str, str]) -> Column:
    """The reason of the first guard, in the order G1, G2, G3, G4, G4b, G6, G5, whose verdict is a refusal; null if all pass."""
    order = ["G1", "G2", "G3", "G4", "G4b", "G6", "G5"]
    return F.coalesce(*[F.when(verdicts[g].startswith("refuse"), F.lit(reasons[g])) for g in order if g in verdicts])


def providers_in_order(providers: DataFrame) -> DataFrame:
    """Configured providers whose circuit isn't open, in failover order, of (name, position, configured, is_open)."""
    return providers.where(F.col("configured") & ~F.col("is_open")).orderBy("position")


def speech_text(text: Column, most: int = 1500) -> Column:
    """At most ``most`` characters, to a sentence's end if one is past 60 % of them; terminators are tried in a fixed order."""
    cut = F.substring(text, 1, most)
    ends = [F.length(cut) - F.instr(F.reverse(cut), mark) + 1 for mark in "।.?!"]
    usable = [F.when((F.instr(cut, mark) > 0) & (end > most * 0.6), F.substring(cut, F.lit(1), end)) for mark, end in zip("।.?!", ends, strict=True)]
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(*usable, cut))


ANSWER = "answer string, citations array<int>, sufficient_context boolean, repaired boolean"
#: What a model is asked to answer with, in the two profiles.
STRUCTURED = {"v1": "answer string, citations array<int>, sufficient_context boolean", "v2": "answer string, cited_chunk_ids array<string>, used_context boolean, self_confidence double"}


def structured(raw: Column, profile: str = "v2") -> Column:
    """Well-formed answers by their schema, with defaults for what they leave out."""
    got = F.from_json(raw, STRUCTURED[profile])
    if profile == "v1":
        return F.struct(F.coalesce(got["answer"], F.lit("")).alias("answer"), F.coalesce(got["citations"], F.array().cast("array<int>")).alias("citations"), F.coalesce(got["sufficient_context"], F.lit(True)).alias("sufficient_context"))
    return F.struct(F.coalesce(got["answer"], F.lit("")).alias("answer"), F.coalesce(got["cited_chunk_ids"], F.array().cast("array<string>")).alias("cited_chunk_ids"), F.coalesce(got["used_context"], F.lit(True)).alias("used_context"), F.coalesce(got["self_confidence"], F.lit(0.5)).alias("self_confidence"))


def _object(json: Column, repaired: bool) -> Column:
    """The answer in a JSON object that has one; null if the text isn't an object or has none."""
    value = F.try_parse_json(F.when(json.rlike(r"(?s)^\{.*\}$"), json))
    answer = F.try_variant_get(value, "$.answer", "string")
    cited = F.coalesce(F.try_variant_get(value, "$.citations", "array<int>"), F.array().cast("array<int>"))
    enough = F.coalesce(F.try_variant_get(value, "$.sufficient_context", "boolean"), F.lit(True))
    return F.when(answer.isNotNull(), F.struct(answer.alias("answer"), cited.alias("citations"), enough.alias("sufficient_context"), F.lit(repaired).alias("repaired")))


def parse_answer(raw: Column) -> Column:
    """(answer, citations, sufficient_context, repaired): the first of an object, fenced or not; an object within prose; the
    closed answer of a truncated object, with the citations of closed lists; the text itself. An empty text has no answer."""
    none = F.array().cast("array<int>")
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""))
    body = F.when(text.rlike(r"(?s)^```(?:json)?\s*.*?\s*```$"), F.regexp_extract(text, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)).otherwise(text)
    within = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    # possessive, for a long answer would take a frame of the stack for each character
    quoted = r'(?s)"answer"\s*:\s*"((?:[^"\\]++|\\.)*+)"'
    said = F.regexp_extract(body, quoted, 1)
    unescaped = F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), said, F.lit('"'))), "$", "string"), said)
    listed = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(r'"citations"\s*:\s*\[([\d,\s]*)\]'), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))))
    truncated = F.when(body.rlike(quoted), F.struct(unescaped.alias("answer"), listed.cast("array<int>").alias("citations"), F.lit(True).alias("sufficient_context"), F.lit(True).alias("repaired")))
    plain = F.struct(body.alias("answer"), none.alias("citations"), (text != "").alias("sufficient_context"), F.lit(True).alias("repaired"))
    return F.when(text == "", plain).otherwise(F.coalesce(_object(body, False), _object(within, True), truncated, plain))


#: What v1 says without passages, and before the passage that stands for an answer.
NO_PASSAGE = "No relevant passages were found for this question."
LEAD = "Answer generation is currently unavailable, so here is the most relevant passage retrieved for this question:\n\n"
#: Characters that an answer takes from a passage when no model answers.
EXTRACT = {"v1": 600, "v2": 800}


def extractive(passages: Column, profile: str = "v2") -> Column:
    """The beginning of the first passage, in v1 behind a sentence that says why; v1 also has a sentence for no passages."""
    first = F.substring(F.trim(F.get(passages, F.lit(0))), 1, EXTRACT[profile])
    if profile == "v2":
        return first
    return F.when(F.size(passages) == 0, NO_PASSAGE).otherwise(F.concat(F.lit(LEAD), first))


def kept_citations(cited: Column, available: Column, profile: str = "v2") -> Column:
    """The available citations that are cited; if none is, the first three (v2) or the first (v1)."""
    kept = F.filter(available, lambda c: F.array_contains(cited, c))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(available, 1, 3 if profile == "v2" else 1))


def breaker_replay(attempts: DataFrame, key: str, order: str, failed: str, threshold: int = 3) -> DataFrame:
    """State of the circuit after each attempt, without cool-down: open from the threshold-th failure in a row until a success."""
    w = Window.partitionBy(key).orderBy(order)
    resets = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = attempts.withColumn("streak", resets)
    row = F.sum(F.col(failed).cast("long")).over(Window.partitionBy(key, "streak").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("failures", row).withColumn("is_open", F.col("failures") >= threshold).drop("streak")


class Breaker:
    """Circuit with cool-down. v1 lets one trial through when it is over, whose failure opens the circuit again; v2 starts anew."""

    def __init__(self, threshold: int = 3, cooldown: float = 60.0, profile: str = "v1", failures: int = 0, opened: float | None = None):
        self.threshold, self.cooldown, self.profile, self.failures, self.opened = threshold, cooldown, profile, failures, opened
        self.trial = False

    def state(self, now: float) -> str:
        if self.opened is not None and now - self.opened >= self.cooldown:
            self.opened, self.failures, self.trial = None, max(0, self.threshold - 1) if self.profile == "v1" else 0, self.profile == "v1"
        return "open" if self.opened is not None else "half_open" if self.trial else "closed"

    def record(self, ok: bool, now: float) -> None:
        self.state(now)
        self.trial = False
        if ok:
            self.failures, self.opened = 0, None
        else:
            self.failures += 1
            if self.failures >= self.threshold and self.opened is None:
                self.opened = now


def retryable(error: str) -> bool:
    return bool(re.search(r"(?i)timeout|timed out|rate|429|5\d\d|unavailable|connection", error))


def failover(providers: dict[str, Callable[[int], str]], breakers: dict[str, Breaker], retries: int = 2, now: float = 0.0) -> tuple[str | None, list[tuple[str, str]]]:
    """Asks providers in order, repeats retryable failures, skips open circuits; the answer and the log of attempts."""
    log: list[tuple[str, str]] = []
    for name, ask in providers.items():
        if breakers[name].state(now) == "open":
            log.append((name, "skipped"))
            continue
        for attempt in range(retries + 1):
            try:
                answer = ask(attempt)
            except RuntimeError as e:
                breakers[name].record(False, now)
                log.append((name, f"failed: {e}"))
                if not retryable(str(e)):
                    break
            else:
                breakers[name].record(True, now)
                log.append((name, "ok"))
                return answer, log
    return None, log
