"""Dot patterns as strings (character i is dot i), integers (dot 1 lowest) and characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_BITS = "000000"
BLANK_CHAR = "⠀"
ALL_DOTS = "111111"


def bits_to_label(bits: Column) -> Column:
    return F.conv(F.reverse(bits), 2, 10).cast("int")


def label_to_bits(label: Column) -> Column:
    """Null outside 0..63, where lpad would cut."""
    return F.when(label.between(0, 63), F.reverse(F.lpad(F.bin(label), 6, "0")))


def dot_char(bits: Column) -> Column:
    """The code point 0x2800 + label; char() takes its argument modulo 256."""
    return F.decode(F.unhex(F.hex(bits_to_label(bits) + F.lit(0x2800))), "UTF-16BE")


def mirror_bits(bits: Column) -> Column:
    """Pattern of a horizontally flipped cell."""
    return F.concat(F.substring(bits, 4, 3), F.substring(bits, 1, 3))


def logits_to_bits(logits: Column) -> Column:
    """sigmoid(x) > 1/2 is x > 0."""
    return F.array_join(F.transform(logits, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def class_to_bits(n_classes: Column, cls: Column) -> Column:
    """A detector with one class says nothing of the pattern."""
    return F.when(n_classes == 1, BLANK_BITS).otherwise(label_to_bits(cls))


def blank_to_space(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, BLANK_CHAR, " "), r"^\s+|\s+$", "")
