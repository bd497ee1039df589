"""Schemas, statuses and errors shared by the operators."""

from __future__ import annotations

WORD, NUMBER, PUNCTUATION = 0, 1, 2
EXACT, GREATER, LESSER, FUZZY = "match_exact", "match_greater", "match_lesser", "match_fuzzy"
STATUSES = (EXACT, GREATER, LESSER, FUZZY)
#: Separates extractions in the joint token match.
DELIMITER = "␟"
WRAPPER_KEY, ATTRIBUTE_SUFFIX, INDEX_SUFFIX = "extractions", "_attributes", "_index"

TOKEN = "struct<index: int, token_type: int, start_pos: int, end_pos: int, first_token_after_newline: boolean>"
CHAR_INTERVAL = "struct<start_pos: int, end_pos: int>"
TOKEN_INTERVAL = "struct<start_index: int, end_index: int>"
CHUNK_FIELDS = "chunk_index int, token_start int, token_end int, char_start int, char_end int, chunk_text string"
EXTRACTION = (
    f"struct<extraction_class: string, extraction_text: string, char_interval: {CHAR_INTERVAL}, alignment_status: string, "
    "extraction_index: int, group_index: int, description: string, attributes: string>"
)
ANNOTATED_DOCUMENT = f"extractions array<{EXTRACTION}>, text string, document_id string"


class ExtractionError(Exception):
    """Root of the library's errors."""


class InvalidDatasetError(ExtractionError):
    """A dataset that can't be read, or has no rows."""


class InvalidDocumentError(ExtractionError):
    """Document ids that are empty or repeat."""


class TokenIntervalError(ExtractionError):
    """A token interval outside its text."""


class SentenceRangeError(ExtractionError):
    """A sentence start outside the tokens."""


class FormatError(ExtractionError):
    """Model output that isn't what the format asks for."""


class PromptTemplateError(ExtractionError):
    """A prompt template that can't be read."""


class ProviderError(ExtractionError):
    """A provider that can't be made, or fails."""


class PromptAlignmentError(RuntimeError):
    """Examples whose extractions aren't found in their own text."""
