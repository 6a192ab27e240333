"""Column expressions over text: normalisation, hashes, splits, clipping, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Case folded (lower case with sharp s as ss), white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text, in hex: what identifies a text."""
    return F.sha2(normalised(text), 256)


def group_id(source: Column, text: Column) -> Column:
    """Source and the first 20 hex digits of the text's hash: texts of one group never part."""
    return F.concat(source, F.lit("/"), F.substring(text_hash(text), 1, 20))


def hash64(value: Column) -> Column:
    """The first 8 bytes of a SHA-256 as an unsigned number, decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def uniform(value: Column) -> Column:
    """A number in [0, 1) that depends on the value alone: 52 bits of its hash."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def split_of(gid: Column, seed: int) -> Column:
    """70/10/10/10 by group: train, dev, calibration or test."""
    b = hash64(F.concat(F.lit(f"{seed}:split:"), gid)) % 10
    return F.when(b < 7, "train").when(b == 7, "dev").when(b == 8, "calibration").otherwise("test")


def order_hash(gid: Column, seed: int) -> Column:
    """A hash to sort groups by: the same order in every run of a seed."""
    return F.sha2(F.concat(F.lit(f"{seed}:order:"), gid), 256)


def word_clip(text: Column, words: int) -> Column:
    """The first words of a text, single spaces between them."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, words), " ")


def word_count(text: Column) -> Column:
    """White-space words of a text; 0 for null or blank."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def escape_control(text: Column) -> Column:
    """Control strings of the form <|name|> made harmless by broken bars."""
    return F.regexp_replace(text, r"<\|([^|<>]*)\|>", "<¦$1¦>")


def option_text(name: Column, description: Column) -> Column:
    """`name: description`, or the name alone if the description is null or empty."""
    return F.when(F.coalesce(description, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(": "), description))


def after_thinking(text: Column, thinking: bool) -> Column:
    """The answer part of a generation: with thinking what follows the first end mark (none: empty), else the last segment."""
    mark = "</think>"
    if not thinking:
        return F.substring_index(text, mark, -1)
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + F.lit(len(mark)))).otherwise("")


def question_mark(text: Column) -> Column:
    """Trimmed, exactly one question mark at the end."""
    return F.concat(F.regexp_replace(F.trim(text), r"\?+$", ""), F.lit("?"))
