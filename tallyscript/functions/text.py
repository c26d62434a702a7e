"""Column functions on transcript text: clocks, speakers, normal forms. Nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of a transcript line, of lines that are scored and shifted (one-word speakers), and of bracketed spans.
LINE = r"^(\d{1,2}:\d{2})\s+([^:]+):\s*(.*)$"
ONE_WORD_LINE = r"^(\d{1,2}:\d{2})\s+(\w+):\s*(.*)$"
SCORED_LINE = r"^\d{1,2}:\d{2}\s+\w+:"
BRACKETS = r"\[([^\]]+)\]"

#: Fixed synonyms of speakers.
SPEAKERS = {
    "teacher": ["anna", "ava", "adult female", "teacher"],
    "student_a06": ["a06", "student 1", "boy student", "student boy"],
    "student_a04": ["a04", "student 2", "girl student", "student girl"],
    "background_student": ["bs", "background student", "other student"],
}

#: Fixed prefixes of lines that are no speech, by generation of the format.
METADATA_V04 = ("===", "---", "Generated:", "Model:")
METADATA_V03 = (*METADATA_V04, "Prompt:", "Chunk size:", "Validation:")

#: Fixed marks of earlier reviews that context leaves out.
QUALITY_MARKS = "[✅⚠️🚨]\\s*"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def clock_seconds(clock: Column) -> Column:
    """MM:SS to seconds; 0 for anything that hasn't two parts."""
    parts = F.split(clock, ":", -1)
    return F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(1)).try_cast("double") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("double")).otherwise(F.when(clock.isNotNull(), 0.0))


def seconds_clock(seconds: Column) -> Column:
    """Seconds to MM:SS with at least two digits each; parts of a second are cut off."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), (seconds % 60).cast("long"))


def without_visual(content: Column) -> Column:
    return strip(F.regexp_replace(content, BRACKETS, ""))


def visual_of(content: Column) -> Column:
    return F.array_join(F.regexp_extract_all(content, F.lit(BRACKETS), F.lit(1)), " ")


def speaker_name(speaker: Column) -> Column:
    """One name for the known variants of a speaker; else lower case with "_" for spaces."""
    low = F.lower(strip(speaker))
    named = None
    for name, variants in SPEAKERS.items():
        named = F.when(low.isin(variants), name) if named is None else named.when(low.isin(variants), name)
    return named.otherwise(F.replace(low, F.lit(" "), F.lit("_")))


def plain_words(text: Column) -> Column:
    """Lower case, without punctuation and doubled white space, and with three contractions written as one word."""
    text = strip(F.regexp_replace(F.regexp_replace(F.lower(text), r"[.,!?;:]", ""), r"\s+", " "))
    for short in ("s", "ll", "re"):
        text = F.replace(text, F.lit("'" + short), F.lit(short))
    return text


def is_metadata(line: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | line.startswith(p)
    return found


def keeps_context(line: Column) -> Column:
    """Whether a line looks like speech: a colon, and a digit among its first ten characters."""
    return line.contains(":") & F.substring(line, 1, 10).rlike("[0-9]")


#: Fixed marks of a failed transcript in the older format: those that context leaves out, and the one that assembly does.
FAILED_CONTEXT_V03, FAILED_PART_V03 = ("[CONSENSUS_FAILED", "[VALIDATION_FAILED"), ("[CONSENSUS_FAILED",)


def failed(text: Column) -> Column:
    """Whether a transcript is the text of a failure."""
    return text.startswith("[")


def failed_v03(text: Column, marks: tuple[str, ...] = FAILED_CONTEXT_V03) -> Column:
    """The same by the older format's marks, which let other bracketed texts pass."""
    return is_metadata(text, marks)
