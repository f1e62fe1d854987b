"""What the SQL expects, stated once more: fixed values, not taken from the package.

A value changed on one side only makes the queries that show it differ.
"""

from __future__ import annotations

STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "did", "do", "does", "for",
    "from", "had", "has", "have", "how", "i", "if", "in", "into", "is", "it", "its", "may",
    "of", "on", "or", "our", "s", "shall", "should", "so", "such", "t", "than", "that", "the",
    "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were",
    "what", "when", "where", "which", "who", "whom", "why", "will", "with", "would", "you",
    "your",
)
KEYWORDS = (
    "class", "interface", "function", "return", "const", "let", "var", "public", "private",
    "protected", "SELECT", "FROM", "WHERE", "JOIN", "GROUP BY", "ORDER BY", "HAVING", "INSERT",
    "UPDATE", "DELETE",
)

REASON_ALPHANUMERIC = "Extracted text contains very little alphanumeric content"
REASON_EMPTY = "No text was extracted"
REASON_FEW_CHARACTERS = "Very little text was extracted"
REASON_FEW_WORDS = "No meaningful words were detected"
REASON_LONG_TOKENS = "Extracted text contains unusually long tokens"
REASON_ODD_WORDS = "Extracted text contains unusually structured words"
REASON_REPETITION = "Extracted text contains excessive token repetition"
REASON_SHORT_WORDS = "Extracted words are unusually short"
REASON_SINGLES = "Extracted text contains many single-character tokens"
REASON_SUSPICIOUS = "Extracted text contains suspicious characters"
REASON_UNPRINTABLE = "Extracted text contains too many non-printable characters"
REASON_UNREADABLE = "Extracted tokens do not resemble normal readable text"
REASON_VOWELS = "Extracted language has unusually low vowel content"

MESSAGE_ANSWER_FAILED = "Something went wrong while answering the question. Please try again."
MESSAGE_BROKEN_IMAGE = (
    "We couldn't run OCR on this image. It may be corrupted or use an unsupported format."
)
MESSAGE_BROKEN_PDF = (
    "We couldn't extract text from this PDF. It may be corrupted or use an unsupported format."
)
MESSAGE_EMPTY_IMAGE = (
    "No text could be detected in this image. Try a clearer photo or a higher-resolution scan."
)
MESSAGE_EMPTY_PDF = "No readable text could be extracted from this PDF."
MESSAGE_NOTHING_TO_SUMMARIZE = "There is no extracted text to summarize."
MESSAGE_NOT_JSON = "Request body must be JSON."
MESSAGE_NO_DOCUMENT = "There is no document text to work with."
MESSAGE_NO_QUESTION = "No question was provided."
MESSAGE_NO_SUMMARY = "The summarizer did not return any summary text."
MESSAGE_NO_TEXT = "No document text was provided."
MESSAGE_NO_TEXT_TO_SUMMARIZE = "No document text was provided to summarize."
MESSAGE_QUESTIONS_FAILED = "Could not generate suggested questions for this document."
MESSAGE_SHORT_DOCUMENT = "The extracted text is too short to ask questions about."
MESSAGE_SUMMARY_FAILED = "Something went wrong while generating the summary. Please try again."

SAMPLE_GAP = "\n\n[…]\n\n"
LONG_COPIES = 8
PAGE_CHARS = 1800
