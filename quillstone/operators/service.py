"""The query paths of both profiles on batches: guards in order, scopes, fallbacks, refusals with the checks made so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import answers

#: The guards of v2 in the order they are asked, and the reasons of their refusals.
GUARDS = ("G1", "G2", "G3", "G4", "G4b", "G6", "G5")
REASONS = {"G3": "off_topic", "G4": "low_retrieval_confidence", "G4b": "low_retrieval_confidence", "G6": "invalid_citations", "G5": "ungrounded_output"}
#: What a refusal says, by reason.
MESSAGES = {
    "unsafe_input": "I can't help with that request.",
    "prompt_injection": "That request looks like an attempt to change my instructions, so I won't act on it.",
    "off_topic": "That question is outside what this knowledge base covers, so I don't have grounded information to answer it.",
    "low_retrieval_confidence": "I couldn't find passages relevant enough to answer that confidently.",
    "ungrounded_output": "I drafted an answer but couldn't verify it against the retrieved sources, so I'm not going to state it.",
    "invalid_citations": "The draft answer cited sources that don't exist, so I've withheld it.",
    "generation_failed": "The answer service is unavailable right now.",
}


def message(reason: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[reason]


def prefixed(text: Column, kind: str) -> Column:
    """What the embedding model wants before a query and a passage."""
    return F.concat(F.lit({"query": "query: ", "passage": "passage: "}[kind]), text)


SCOPES = ("all", "same", "english")


def within(scope: str, language: Column, query_lang: Column) -> Column:
    """Whether a query sees a chunk: any chunk, those in its own language, or English ones. A predicate, so that no pairs are made for it."""
    if scope not in SCOPES:
        raise ValueError(f"scope {scope} isn't one of {', '.join(SCOPES)}")
    return {"all": F.lit(True), "same": F.coalesce(language == query_lang, F.lit(False)), "english": F.coalesce(language == "en", F.lit(False))}[scope]


def seen(chunks: DataFrame, queries: DataFrame, scope: str = "all") -> DataFrame:
    """qid and how many chunks (language) its query (qid, lang) sees: chunks are counted by language, queries look the numbers up."""
    counts = chunks.groupBy(F.coalesce("language", F.lit("")).alias("language")).agg(F.count(F.lit(1)).alias("n_chunks"))
    if scope == "same":
        return queries.join(counts, F.col("lang") == F.col("language"), "left").select("qid", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    total = counts.where(within(scope, F.col("language"), F.lit(None).cast("string"))).agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"))
    return queries.select("qid").join(F.broadcast(total))  # one row


def above(hits: DataFrame, threshold: float | None = None, strategies: list[str] | None = None) -> DataFrame:
    """Hits whose score reaches the threshold, of these strategies; bm25 only if they are all or name it."""
    kept = hits if threshold is None else hits.where(F.col("score") >= threshold)
    return kept if strategies is None else kept.where(F.col("strategy").isin(strategies))


def input_reason(text: Column) -> Column:
    """Which guard refuses and why, or null."""
    trimmed = F.trim(text)
    return (
        F.when(F.length(trimmed) < 2, F.struct(F.lit("G1").alias("guard"), F.lit("unsafe_input").alias("reason")))
        .when(answers.matches(trimmed, answers.INJECTION_V2), F.struct(F.lit("G1").alias("guard"), F.lit("prompt_injection").alias("reason")))
        .when(answers.matches(text, answers.UNSAFE_V2), F.struct(F.lit("G2").alias("guard"), F.lit("unsafe_input").alias("reason")))
    )


def answered_v2(
    rows: DataFrame, offtopic_tau: float = 0.70, top_tau: float = 0.72, flatness_min: float = 1.04, refuse: float = 0.60, warn: float = 0.85, debug: bool = True
) -> DataFrame:
    """The v2 path for rows of a batch: each has what its stages found, null where a stage wasn't reached.

    In: qid, text, similarity (with any centroid; null without centroids), top_score, flatness (null: endless), contexts
    (array of chunk_id and text in rank order), generated (answer, cited_chunk_ids, used_context; null if generation failed)
    and grounded (share of supported sentences; null if none is to be verified). Out: qid, answered, refusal_reason, message,
    answer, citations, checks (guard, passed, in the order asked, up to the one that refuses) and, in debug, the contexts.
    Contexts without text aren't shown. The plan stays one projection: later verdicts are only looked at where no earlier one refuses.
    """
    shown = F.filter("contexts", lambda c: F.coalesce(c["text"], F.lit("")) != "")
    first = rows.withColumns({"shown": shown, "input": input_reason(F.col("text"))})
    ids = F.transform("shown", lambda c: c["chunk_id"])
    cited = F.coalesce(F.col("generated.cited_chunk_ids"), F.array().cast("array<string>"))
    valid = F.filter(cited, lambda c: F.array_contains(ids, c))
    confident = (F.coalesce("top_score", F.lit(0.0)) >= top_tau) & (F.coalesce("flatness", F.lit(1e9)) >= flatness_min)
    fails = {
        "G1": F.coalesce(F.col("input.guard") == "G1", F.lit(False)),
        "G2": F.coalesce(F.col("input.guard") == "G2", F.lit(False)),
        "G3": F.coalesce(F.col("similarity") < offtopic_tau, F.lit(False)),
        "G4": ~confident,
        "G4b": ~F.coalesce(F.col("generated.used_context"), F.lit(True)),
        "G6": (F.size(cited) > 0) & (F.size(valid) == 0),
        "G5": F.coalesce(F.col("grounded") < refuse, F.lit(False)),
    }
    # no context left refuses like G4, without failing its check; so does a generation that failed, after it
    stops = [(g, fails[g], F.coalesce(F.col("input.reason"), F.lit("")) if g in ("G1", "G2") else F.lit(REASONS[g])) for g in GUARDS]
    stops.insert(4, ("no_context", F.size("shown") == 0, F.lit("low_retrieval_confidence")))
    stops.insert(5, ("generation", F.col("generated").isNull(), F.lit("generation_failed")))
    stop, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for at, (_, failed, why) in reversed(list(enumerate(stops))):
        stop, reason = F.when(failed, F.lit(at)).otherwise(stop), F.when(failed, why).otherwise(reason)
    placed = first.withColumns({"stop": stop, "refusal_reason": reason, "cited": cited})
    # G4b is only written down when it refuses
    listed = [F.when(F.coalesce(F.col("stop"), F.lit(len(stops))) >= at, F.struct(F.lit(g).alias("guard"), (F.coalesce(F.col("stop"), F.lit(len(stops))) != at).alias("passed"))) for at, (g, _, _) in enumerate(stops) if g in GUARDS and g != "G4b"]
    abstained = F.when(F.col("stop") == next(at for at, x in enumerate(stops) if x[0] == "G4b"), F.struct(F.lit("G4b").alias("guard"), F.lit(False).alias("passed")))
    checks = F.array_compact(F.array(*listed[:4], abstained, *listed[4:]))
    answered = F.col("refusal_reason").isNull()
    after_search = F.coalesce(F.col("stop"), F.lit(len(stops))) > 2
    citations = F.when(answered, answers.kept_citations(F.col("cited"), F.transform("shown", lambda c: c["chunk_id"]))).when(after_search, F.transform("shown", lambda c: c["chunk_id"])).otherwise(F.array().cast("array<string>"))
    support = F.when(answered, F.when(F.coalesce("grounded", F.lit(1.0)) < warn, "warn").otherwise("pass"))
    return placed.select(
        "qid", answered.alias("answered"), "refusal_reason", message(F.col("refusal_reason")).alias("message"), F.when(answered, F.col("generated.answer")).alias("answer"), citations.alias("citations"),
        checks.alias("checks"), support.alias("support"), (F.col("shown") if debug else F.array_compact(F.array(F.when(F.lit(False), F.get("shown", F.lit(0)))))).alias("retrieved"),
    )


def screened_v1(text: Column, safety: bool = True, offtopic: bool = True) -> Column:
    """v1 before the search: the refusal's status, or null; what is sanitized is what the second guard sees."""
    unsafe = F.when(F.lit(safety) & answers.guard_input_v1(text).startswith("block"), "refused_unsafe")
    return F.coalesce(unsafe, F.when(F.lit(offtopic) & answers.guard_offtopic_v1(T.sanitize(text)).startswith("block"), "refused_off_topic"))


def composed_v1(text: Column, scores: Column, grounding: Column, enabled: bool = True) -> Column:
    """v1 from end to end: the status of the first stage that blocks (input, off topic, confidence, grounding), or answered."""
    if not enabled:
        return F.lit("answered")
    late = F.when(answers.confidence_v1(scores) == "block", "refused_low_confidence").when(grounding.startswith("block"), "refused_ungrounded")
    return F.coalesce(screened_v1(text), late, F.lit("answered"))


#: What v1 says when it refuses, by status; what it found goes behind it.
MESSAGES_V1 = {
    "refused_unsafe": "This query was blocked by the input safety check. Try rephrasing it as a factual question about the dataset.",
    "refused_off_topic": "This system answers factual questions from a retrieved web-passage corpus. It cannot chat, write content, or give personal advice.",
    "refused_low_confidence": "No passage in the indexed corpus is relevant enough to answer this confidently. Rather than guess, the system is declining — try rephrasing, or ask about a topic covered by MS MARCO web passages.",
    "refused_ungrounded": "A draft answer was generated but too much of it could not be traced back to the retrieved passages, so it was withheld as likely unreliable.",
}


def message_v1(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MESSAGES_V1.items() for x in pair])[status]


#: Media types that uploads may have, and their size.
MEDIA_TYPES = ("audio/mpeg", "audio/mp3", "audio/mpeg3", "audio/x-mpeg-3", "audio/x-mp3", "audio/wav", "audio/x-wav", "audio/wave", "audio/pcm_s16le")
MOST_BYTES = 10 * 1024 * 1024


def upload(transcript: Column, size: Column, media_type: Column, most: int = MOST_BYTES) -> Column:
    """What an upload fails by: empty, too_large, an unsupported media type, no_speech in it; or ok."""
    kind = F.lower(F.trim(F.substring_index(media_type, ";", 1)))
    return F.when(size == 0, "empty").when(size > most, "too_large").when(~kind.isin(*MEDIA_TYPES), "unsupported").when(F.trim(F.coalesce(transcript, F.lit(""))) == "", "no_speech").otherwise("ok")
