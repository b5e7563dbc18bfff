"""Column forms of text functions whose meaning differs between Python, Java and SQL; Python's is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python has it: Unicode's, and U+001C to U+001F.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column | str) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(_col(c), rf"{SPACE}+", " ")


def n_words(c: Column | str) -> Column:
    return F.size(F.filter(F.split(_col(c), rf"{SPACE}+"), lambda w: w != ""))


def normalised(c: Column | str) -> Column:
    """Stripped, lower case, single blanks: what question hashes and shingles are made from."""
    return collapse(F.lower(strip(c)))


def first_turn(conversations: Column | str, role: str) -> Column:
    """Value of the first turn of a role, "" where there is none."""
    turns = F.filter(_col(conversations), lambda t: t["from"] == role)
    return F.coalesce(F.get(turns, 0)["value"], F.lit(""))


def without_thoughts(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), r"(?s)<think>.*?</think>", ""))


def without_fences(c: Column | str) -> Column:
    """Without a code fence that opens or closes the text."""
    opened = F.regexp_replace(_col(c), r"(?U)\A```\w*\n?", "")
    return strip(F.regexp_replace(opened, r"(?d)\n?```(?=\n?\z)", ""))


def decoded(content: Column | str) -> Column:
    """File bytes as text: invalid UTF-8 becomes U+FFFD, CRLF and CR become LF."""
    return F.regexp_replace(F.make_valid_utf8(_col(content).cast("string")), r"\r\n?", "\n")
