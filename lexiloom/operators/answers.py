"""Answers from retrieved chunks: prompts, grounded generation with checked citations, fallbacks and disclaimers.

Everything but the model's reply is a column expression, so a batch of questions is answered by one plan; a reply comes
from an injected chat client inside the partitions, and is null where the client fails.

``chunks`` is an array of (id, content, source), a question's top list, so it fits in a row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import format_answer
from lexiloom.operators.understanding import checked_citations, question_type, variations

TYPES = ("factual", "procedural", "troubleshooting", "navigational", "exploratory")
LEAST_CONFIDENCE, DISCLAIMED_BELOW = 0.3, 0.5
SHOWN_PASSAGES, PASSAGE_CHARS = 3, 200
#: What an answer of each type should be; the last one is for any other type.
STYLES = {
    "factual": "State the fact asked for, briefly.",
    "procedural": "Give the steps in order, numbered.",
    "troubleshooting": "Name the likely cause, then how to mend it.",
    "navigational": "Say where it is to be found, with the section or address.",
    "exploratory": "Give an overview of the main points.",
    "default": "Answer clearly and completely.",
}
# Words of a question that are no topic.
NO_TOPIC = ("what", "how", "where", "when", "why", "the", "and", "for")
EMPTY_CONTEXT = "There is not enough information to answer that question."
NOT_CONFIGURED = "No model is configured to write answers."
FAILED = "The answer could not be written. Please try again."
NOTHING_FOUND = "Nothing relevant was found. Try other words, or look into the documentation itself."
DISCLAIMER = "This answer rests on little matching content and may not fit the question."
PASSAGES_HEAD, PASSAGES_END = "There is no exact answer, but these passages come closest:", "The answer may stand in one of these sections."


def completion(chat):
    """A column function: the client's reply to each prompt, null where the prompt is null or the call fails."""

    @F.pandas_udf("string")
    def reply(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            try:
                out.append(None if p is None else chat.complete(p))
            except Exception:  # a failing service costs its own rows only
                out.append(None)
        return pd.Series(out, dtype=object)

    return reply.asNondeterministic()


def answer_prompt(question: Column, context: Column, kind: Column) -> Column:
    style = F.lit(STYLES["default"])
    for name in TYPES:
        style = F.when(kind == name, STYLES[name]).otherwise(style)
    return F.concat(F.lit("Use only the context below. "), style, F.lit("\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def grounded_prompt(question: Column, chunks: Column) -> Column:
    """Each chunk under its tag; the reply is to cite tags."""
    shown = F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("[CHUNK:"), c["id"].cast("string"), F.lit("]\n"), F.coalesce(c["content"], F.lit("")))), "\n\n")
    return F.concat(F.lit("Answer from these chunks only, and cite the tag of each chunk that you use. Say so if they do not hold the answer.\n\n"), shown, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def context_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


def fallback_answer(question: Column) -> Column:
    """What to say when there is no answer, with the first two words of the question's topic."""
    words = F.filter(F.regexp_extract_all(question, F.lit(r"(?U)\b(\w{3,})\b"), F.lit(1)), lambda w: ~F.lower(w).isin(*NO_TOPIC))
    topic = F.array_join(F.slice(words, 1, 2), " ")
    return F.when(topic != "", F.concat(F.lit("There is not enough information about "), topic, F.lit(". Try other or more specific words."))).otherwise("There is not enough information. Try asking about a specific topic.")


def passages_answer(chunks: Column) -> Column:
    """The best passages themselves, for a question without an answer."""

    def one(c: Column) -> Column:
        text = F.coalesce(c["content"], F.lit(""))
        short = F.when(F.length(text) > PASSAGE_CHARS, F.concat(F.substring(text, 1, PASSAGE_CHARS), F.lit("..."))).otherwise(text)
        return F.concat(F.lit("[CHUNK:"), c["id"].cast("string"), F.lit('] "'), short, F.lit('"\nSource: '), F.coalesce(F.nullif(c["source"], F.lit("")), F.lit("unknown")))

    shown = F.array_join(F.transform(F.slice(chunks, 1, SHOWN_PASSAGES), one), "\n\n")
    return F.when(F.coalesce(F.size(chunks), F.lit(0)) > 0, F.concat(F.lit(PASSAGES_HEAD + "\n\n"), shown, F.lit("\n\n" + PASSAGES_END))).otherwise(NOTHING_FOUND)


def disclaimer(confidence: Column) -> Column:
    return F.when(confidence < DISCLAIMED_BELOW, DISCLAIMER)


def generated(rows: DataFrame, chat=None) -> DataFrame:
    """Adds answer and disclaimer to (question, context, query_type, confidence)."""
    context = F.coalesce("context", F.lit(""))
    if chat is None:
        said = F.lit(NOT_CONFIGURED)
    else:
        rows = rows.withColumn("_reply", completion(chat)(F.when(F.trim(context) != "", answer_prompt(F.col("question"), context, F.col("query_type")))))
        said = F.coalesce(format_answer(F.col("_reply")), F.lit(FAILED))
    answer = F.when(F.trim(context) == "", EMPTY_CONTEXT).otherwise(said)
    return rows.withColumn("answer", answer).withColumn("disclaimer", disclaimer(F.col("confidence"))).drop("_reply")


def with_sources(answer: Column, sources: Column) -> Column:
    """``sources``: array of (title, url)."""
    return format_answer(answer, F.transform(sources, lambda s: F.when(F.coalesce(s["url"], F.lit("")) != "", F.concat(F.coalesce(s["title"], F.lit("Unknown")), F.lit(" ("), s["url"], F.lit(")"))).otherwise(F.coalesce(s["title"], F.lit("Unknown")))))


def grounded(rows: DataFrame, chat=None) -> DataFrame:
    """Adds answer, cited, valid_citations, invalid_citations, is_valid, used_fallback to (question, chunks, confidence).

    Little confidence, or no chunks, gives passages; a failing client too; without a client the answer says so.
    """
    poor = (F.col("confidence") < LEAST_CONFIDENCE) | (F.coalesce(F.size("chunks"), F.lit(0)) == 0)
    rows = rows.withColumn("_poor", F.coalesce(poor, F.lit(True)))
    if chat is None:
        rows = rows.withColumn("_said", F.lit(NOT_CONFIGURED)).withColumn("_reply", F.lit(None).cast("string"))
    else:
        rows = rows.withColumn("_reply", completion(chat)(F.when(~F.col("_poor"), grounded_prompt(F.col("question"), F.col("chunks")))))
        rows = rows.withColumn("_said", F.trim("_reply"))
    rows = rows.withColumn("used_fallback", F.col("_poor") | F.col("_said").isNull())
    rows = rows.withColumn("answer", F.when(F.col("used_fallback"), passages_answer(F.col("chunks"))).otherwise(F.col("_said")))
    rows = rows.withColumn("_ids", F.transform("chunks", lambda c: c["id"])).withColumn("_text", F.when(F.col("used_fallback"), F.lit("")).otherwise(F.col("answer")))
    return checked_citations(rows, "_ids", "_text").drop("_poor", "_said", "_reply", "_ids", "_text")


def classified(questions: DataFrame, chat, text: str = "text") -> DataFrame:
    """Adds query_type: the client's, if it is a type there is, else the rules'."""
    prompt = F.concat(F.lit(f"Which of these types is the question: {', '.join(TYPES)}? Reply with the type alone.\n\nQuestion: "), F.col(text))
    rows = questions.withColumn("_reply", F.lower(F.trim(completion(chat)(prompt))))
    return rows.withColumn("query_type", F.when(F.col("_reply").isin(*TYPES), F.col("_reply")).otherwise(question_type(F.col(text)))).drop("_reply")


def expanded(questions: DataFrame, chat, text: str = "text", most: int = 5) -> DataFrame:
    """Adds variations: the question and the client's wordings, a line each; the rules' where the client fails."""
    prompt = F.concat(F.lit("Write other wordings of this question, one on a line.\n\nQuestion: "), F.col(text))
    rows = questions.withColumn("_reply", completion(chat)(prompt))
    lines = F.filter(F.transform(F.split("_reply", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    made = F.slice(F.array_distinct(F.concat(F.array(F.col(text)), lines)), 1, most)
    return rows.withColumn("variations", F.coalesce(made, variations(F.col(text), most))).drop("_reply")
