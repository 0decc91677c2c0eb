"""Mixed-format dates as one SQL expression.

Every accepted spelling is rewritten to ISO text and then cast, so nothing
throws per row and no date parser object is involved. A cell can match one
shape only; the shapes are tried behind one cheap length-and-digit guard.
Month comes first in ``a/b/yyyy``, day first only where that fails.
"""

from __future__ import annotations

from sluice.functions import fixed
from sluice.functions.sqltext import mapping, pattern, texts

# A clock time may follow the date and is left out of the answer.
CLOCK = (
    r"[ T]\s*(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,9})?)?"
    r"\s*(?:[AaPp][Mm])?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?\z"
)
# The accepted shapes, before their clock is cut off.
SHAPE = (
    r"\A(?:\d{4}(?:[-/.]\d{1,2}(?:[-/.]\d{1,2})?)?"  # 2024, 2024-11, 2024-11-02, 2024/11/14
    r"|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2})"  # 11/03/2024, 13.11.2024, 1/2/24
    r"|\d{8}"  # 20241101
    r"|[A-Za-z]{3,9}\.? \d{1,2},? \d{4}"  # Nov 3, 2024
    r"|\d{1,2}[ -][A-Za-z]{3,9}\.?,?[ -]\d{4})"  # 3 Nov 2024
    r"(?:" + CLOCK.removesuffix(r"\z") + r")?\z"
)
ISO = r"\A\d{4}-\d\d-\d\d\z"
YEAR_FIRST = r"\A(\d{4})([-/.])(\d{1,2})\2(\d{1,2})\z"
YEAR_LAST = r"\A(\d{1,2})([-/.])(\d{1,2})\2(\d{4})\z"
YEAR_LAST_SHORT_20 = r"\A(\d{1,2})([-/.])(\d{1,2})\2([0-5]\d|6[0-8])\z"
YEAR_LAST_SHORT_19 = r"\A(\d{1,2})([-/.])(\d{1,2})\2(69|[7-9]\d)\z"
COMPACT = r"\A(\d{4})(\d{2})(\d{2})\z"
NAME_FIRST = r"\A[A-Za-z]{3,9}\.? (\d{1,2}),? (\d{4})\z"
DAY_FIRST_THEN_NAME = r"\A(\d{1,2})[ -][A-Za-z]{3,9}\.?,?[ -](\d{4})\z"
YEAR_MONTH = r"\A(\d{4})[/.](\d{1,2})\z"

# Dates outside what a 64-bit nanosecond clock can hold are not dates.
FIRST_DAY, LAST_DAY = "1677-09-22", "2262-04-11"
LONGEST = 48


def _month_number(name: str) -> str:
    numbers = {}
    for position, month in enumerate(fixed.MONTHS, start=1):
        numbers[month] = numbers[month[:3]] = str(position)
    numbers["sept"] = "9"
    return f"try_element_at({mapping(numbers)}, lower({name}))"


def dated(x: str) -> str:
    """Stripped text of an accepted shape without its clock; NULL for anything else."""
    ends_well = f"right({x}, 1) IN ({texts('0123456789ZCMm')})"
    fits = f"octet_length({x}) BETWEEN 4 AND {LONGEST} AND {ends_well} AND {x} RLIKE {pattern(SHAPE)}"
    clockless = f"CASE WHEN contains({x}, ':') THEN regexp_replace({x}, {pattern(CLOCK)}, '') ELSE {x} END"
    return f"CASE WHEN {x} RLIKE {pattern(ISO)} THEN {x} WHEN {fits} THEN {clockless} END"


def day_of(shaped: str) -> str:
    """DATE of text that ``dated`` let through; NULL where there is no such day."""

    def rewrite(x: str, *rules: tuple[str, str]) -> str:
        for shape, to in rules:
            x = f"regexp_replace({x}, {pattern(shape)}, '{to}')"
        return x

    numeric = rewrite(
        shaped,
        (YEAR_FIRST, "$1-$3-$4"),
        (YEAR_MONTH, "$1-$2"),
        (COMPACT, "$1-$2-$3"),
        (YEAR_LAST, "$4-$1-$3"),
        (YEAR_LAST_SHORT_20, "20$4-$1-$3"),
        (YEAR_LAST_SHORT_19, "19$4-$1-$3"),
    )
    day_first = rewrite(
        shaped,
        (YEAR_LAST, "$4-$3-$1"),
        (YEAR_LAST_SHORT_20, "20$4-$3-$1"),
        (YEAR_LAST_SHORT_19, "19$4-$3-$1"),
    )
    month = _month_number(f"regexp_extract({shaped}, {pattern('([A-Za-z]+)')}, 1)")
    named = f"replace({rewrite(shaped, (NAME_FIRST, '$2-#-$1'), (DAY_FIRST_THEN_NAME, '$2-#-$1'))}, '#', {month})"
    month_first = f"CASE WHEN {shaped} RLIKE '[A-Za-z]' THEN {named} ELSE {numeric} END"
    # text of the commonest shape reads as it is, whatever the rewritings would try
    return (
        f"CASE WHEN {shaped} LIKE '____-__-__' THEN try_cast({shaped} AS DATE)"
        f" ELSE coalesce(try_cast({month_first} AS DATE), try_cast({day_first} AS DATE)) END"
    )


def plausible(day: str) -> str:
    return f"CASE WHEN {day} BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}' THEN {day} END"


def iso(day: str) -> str:
    """``yyyy-MM-dd``; a cast, so no session time zone is involved."""
    return f"CAST({day} AS STRING)"
