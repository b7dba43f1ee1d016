"""Residues: codes, pairing, normal forms and field checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NT, MOST_NT = 5, 3000
PAIRS = ("gc", "gu", "au", "cg", "ug", "ua")
#: (5' residue, 3' residue, single): the triples that hold.
TRIPLES = ("cgc", "ugc", "uau")


def codes(nt: Column) -> Column:
    """Residues as 1, 2, 4, 8 for a, c, g, u and 0 for others, so that two pair if their or is 6, 9 or 12. Null gives none."""
    marked = F.translate(F.regexp_replace(F.coalesce(nt, F.lit("")), "[^acgu]", "0"), "acgu", "1248")
    return F.filter(F.split(marked, ""), lambda x: x != "").cast("array<tinyint>")


def cssd_join(ss: str, pos_var: str) -> Column:
    return F.concat_ws("\n", ss, pos_var)


def cssd_split(cs: str) -> tuple[Column, Column]:
    """The two lines of a stored pattern; the second is empty if there is none."""
    parts = F.split(cs, "\n", 2)
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def normalize(text: Column) -> Column:
    """Without white space and digits, lower case, t read as u."""
    return F.translate(F.lower(F.regexp_replace(text, r"[\s0-9]+", "")), "t", "u")


def from_letters(text: Column, most: int = 120) -> Column:
    """A made-up sequence from any text: its ASCII letters, dealt to acgu in turn, up to `most` of them."""
    letters = F.lower(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.substring(F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "acguacguacguacguacguacguac"), 1, most)


def is_pair(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin(*PAIRS)


def is_triple(five: Column, three: Column, single: Column, single_first: Column) -> Column:
    """single_first: the single residue stands before the pair, which is then read from its other strand."""
    return F.when(single_first, F.concat(three, five, single)).otherwise(F.concat(five, three, single)).isin(*TRIPLES)


def is_sequence(nt: Column) -> Column:
    return nt.rlike("^[acgu]+$") & F.length(nt).between(LEAST_NT, MOST_NT)


# The characters that each field takes besides letters and digits.
DEFINITION_MARKS, ACCESSION_MARKS, GROUP_MARKS = r" ,_.:/'()-", "_.-", "-"


def field_error(value: Column, name: str, least: int, most: int, marks: str) -> Column:
    """Why a field is refused, or null."""
    return (
        F.when(value.isNull() | (F.length(value) < least), F.lit(f"{name} has fewer than {least} characters"))
        .when(F.length(value) > most, F.lit(f"{name} has more than {most} characters"))
        .when(~value.rlike(f"^[A-Za-z0-9{marks}]*$"), F.lit(f"{name} holds an invalid character"))
    )


def definition_error(value: Column) -> Column:
    return field_error(value, "definition", 10, 200, DEFINITION_MARKS)


def accession_error(value: Column) -> Column:
    return field_error(value, "accession", 3, 20, ACCESSION_MARKS)


def group_error(value: Column) -> Column:
    return field_error(value, "group", 3, 12, GROUP_MARKS)


def sequence_hash(nt: Column) -> Column:
    return F.crc32(nt.cast("binary"))


def substr(text: Column, position: int, length: int) -> Column:
    """From a 0-based position."""
    return F.substring(text, position + 1, length)
