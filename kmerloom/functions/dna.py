"""Cleaning of text to DNA and per-base expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
#: Every letter that is no base becomes A.
_OTHERS = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in BASES)


def clean(text: Column) -> Column:
    """Letters only, upper case, other letters as A; null counts as empty."""
    letters = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))
    return F.translate(letters, _OTHERS, "A" * len(_OTHERS))


_LETTERS = bytes(i for i in range(128) if chr(i).isalpha())
_CLEANED = bytes(c if (c := chr(i).upper().encode("latin-1", "replace")[0]) in BASES.encode() else ord("A") for i in range(256))
_DROPPED = bytes(i for i in range(256) if i not in _LETTERS)


#: Rows that are cleaned together.
ROWS = 1000


def cleaned(batches):
    """Arrow batches (text_id, dna) of raw texts as batches of what ``clean`` gives, by a table of bytes (all bytes of other characters
    are no letters). A function for mapInArrow, or for another one that cleans the texts it reads in its own task."""
    for whole in batches:
        for begin in range(0, whole.num_rows, ROWS):
            batch = whole.slice(begin, ROWS)
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(x or b"").translate(_CLEANED, _DROPPED) for x in raw], pa.binary()).cast(pa.string())], names=["text_id", "dna"])


def raw(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """text_id, dna of a table's rows before they are cleaned."""
    return table.select(F.col(key).cast("long").alias("text_id"), F.col(text).alias("dna"))


def texts(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """text_id, dna of a table's rows, cleaned."""
    return raw(table, key, text).mapInArrow(cleaned, "text_id long, dna string")


def base_value(letter: Column) -> Column:
    """A, C, G, T as 0 to 3, ``$`` as -1, anything else as 0; letters in either case."""
    return F.when(letter == "$", -1).otherwise(F.greatest(F.instr(F.lit(BASES), F.upper(letter)) - 1, F.lit(0)))


def as_bases(text: Column) -> Column:
    """The text with every character as the base that base_value gives it; characters are mapped, not dropped."""
    return F.regexp_replace(F.translate(text, "acgt", "ACGT"), "[^ACGT]", "A")


def base_char(value: Column) -> Column:
    """Inverse of base_value for 0 to 3; ``$`` otherwise."""
    return F.when(value.between(0, 3), F.substring(F.lit(BASES), value.cast("int") + 1, F.lit(1))).otherwise("$")


def base_values(dna: Column, padding: int = 0) -> Column:
    """The text as an array of base values with -1 appended ``padding`` times."""
    letters = F.when(F.length(dna) > 0, F.split(dna, "")).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(letters, lambda c: base_value(c).cast("int")), F.array_repeat(F.lit(-1), padding))
