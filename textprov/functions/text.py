"""String columns: strip, null words, prompt and response formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# CSV cells that the usual data-frame reader takes as missing.
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# The text formats and markers of the prompts and responses.
QUESTION = "\n###\nIs the essay generated by AI?"
SOURCE_HEAD = "### Instruction:\n"
RESPONSE_MARK = "### Response:"
EOS = "</s>"
END_OF_TEXT = "<|endoftext|>"
UNK = "<unk>"
INSTRUCTION_FIELDS = [
    ("Prompt", "prompt_name"),
    ("Task", "task"),
    ("Score", "holistic_essay_score"),
    ("Student Grade Level", "grade_level"),
    ("English Language Learner", "ell_status"),
    ("Disability Status", "student_disability_status"),
]
MISSING_TEXT = "nan"  # how an unfilled missing cell prints


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(text) -> Column:
    """Strip both ends as Python does; ``trim`` takes off blanks only."""
    return F.btrim(_col(text), F.lit(PY_WHITESPACE))


def null_words(text) -> Column:
    """Null where the cell spells a missing value."""
    c = _col(text)
    return F.when(~c.isin(NULL_WORDS), c)


def add_question(text) -> Column:
    return F.concat(py_strip(text), F.lit(QUESTION))


def number_text(value) -> Column:
    """A number as text, whole numbers without a fraction."""
    c = _col(value).cast("double")
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def instruction(numeric=("holistic_essay_score", "grade_level")) -> Column:
    """The six ``Name: value`` lines over the essay columns."""
    lines = []
    for label, name in INSTRUCTION_FIELDS:
        value = number_text(name) if name in numeric else F.col(name)
        lines.append(F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(MISSING_TEXT))))
    return py_strip(F.concat_ws("\n", *lines))


def format_source(instruction_text) -> Column:
    return F.concat(F.lit(SOURCE_HEAD), _col(instruction_text), F.lit(f"\n\n{RESPONSE_MARK} "))


def format_target(response, eos: str = EOS) -> Column:
    return F.concat(_col(response), F.lit(f" {eos}"))


def format_chat(instruction_text, response, eos: str = EOS) -> Column:
    return F.concat(format_source(instruction_text), format_target(response, eos))


def generation_prompt(instruction_text, text, n_chars) -> Column:
    """Source format followed by the first ``n_chars`` characters as a start."""
    return F.concat(format_source(instruction_text), F.substring(_col(text), F.lit(1), n_chars))


def clean_response(text) -> Column:
    """The answer inside a decoded generation.

    The end marker is looked for in the whole text, prompt included; unknown-token
    marks are deleted after the strip, so blanks next to them stay.
    """
    c = _col(text)
    answer = F.substring_index(c, RESPONSE_MARK, -1)
    end = F.when(c.contains(EOS), F.substring_index(answer, EOS, 1)).otherwise(
        F.substring_index(answer, END_OF_TEXT, 1)
    )
    return F.replace(py_strip(end), F.lit(UNK), F.lit(""))


def clean_responses(texts) -> Column:
    """``clean_response`` over a list column."""
    return F.transform(_col(texts), clean_response)
