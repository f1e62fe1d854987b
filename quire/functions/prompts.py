"""Prompt texts.  The wording is our own; slots and rules are fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTHS = ("short", "medium", "long")
DEFAULT_LENGTH = "medium"

LENGTH_GUIDE = {
    "short": "two or three sentences, about 40 to 70 words, with the main point only",
    "medium": "one or two short paragraphs, about 120 to 200 words, with the main line and key details",
    "long": "three to five paragraphs, about 300 to 450 words, complete enough to replace a first reading",
}

SYSTEM_JSON = "Answer with one valid JSON object and nothing else."
SYSTEM_PROSE = "You summarise and explain documents accurately."

SECTION_TOKENS = 500
DIRECT_TOKENS = 2_000
FINAL_TOKENS = 5_000
QUESTION_TOKENS = 2_000
ANSWER_TOKENS = 1_200
DEFAULT_TOKENS = 1_500


def known_length(length: Column) -> Column:
    return F.when(length.isin(*LENGTHS), length).otherwise(DEFAULT_LENGTH)


def length_guide(length: Column) -> Column:
    pairs = [F.lit(x) for item in LENGTH_GUIDE.items() for x in item]
    return F.element_at(F.create_map(*pairs), known_length(length))


def _contract(source: str) -> str:
    return (
        "Reply with one JSON object with the keys title (string), documentType (string), "
        "summary (string), keyPoints, mainIdeas, entities and actionItems (arrays of strings).\n"
        "- title: short and descriptive; documentType: a brief class of document.\n"
        "- keyPoints: 3 to 6 facts; mainIdeas: 2 to 5 themes; entities: at most 8 names, dates or figures.\n"
        "- actionItems: only those the text supports, otherwise [].\n"
        f"- Use only {source}; invent nothing, merge related points, drop repetition.\n"
        "- No markdown, no code fence, no text around the object."
    )


def section_prompt(text: Column, part: Column, parts: Column) -> Column:
    return F.concat(
        F.lit("This is part "), part.cast("string"), F.lit(" of "), parts.cast("string"),
        F.lit(
            " of one document. Note its facts, arguments, names, dates, figures, decisions and "
            "requirements in 150 to 250 words, keep technical terms, add nothing that is not "
            "here.\n\nPart "
        ),
        part.cast("string"), F.lit(':\n"""\n'), text, F.lit('\n"""'),
    )


def direct_prompt(text: Column, length: Column) -> Column:
    return F.concat(
        F.lit("Summarise the document below. Length of the summary: "), length_guide(length),
        F.lit(".\n\n" + _contract("the document") + '\n\nDocument:\n"""\n'), text, F.lit('\n"""'),
    )


def final_prompt(sections: Column, length: Column) -> Column:
    return F.concat(
        F.lit("Merge these section notes of one document into its summary. Length of the summary: "),
        length_guide(length),
        F.lit(".\n\n" + _contract("the section notes") + "\n\nSection notes:\n\n"), sections,
    )


def questions_prompt(sample: Column, count: int) -> Column:
    return F.concat(
        F.lit(
            f"Write exactly {count} specific questions that the text below answers, each one sentence "
            "with a question mark, covering different parts of it. Reply with one JSON object: "
            '{"questions": ["...", "..."]}.\n\nText:\n"""\n'
        ),
        sample, F.lit('\n"""'),
    )


def answer_prompt(question: Column, excerpts: Column) -> Column:
    return F.concat(
        F.lit("Answer from these excerpts of a document only, in two to six sentences; say so if "
              "they do not contain the answer.\n\nQuestion: "),
        question, F.lit("\n\nExcerpts:\n\n"), excerpts,
    )


def system_message(json_mode: Column) -> Column:
    return F.when(json_mode, SYSTEM_JSON).otherwise(SYSTEM_PROSE)
