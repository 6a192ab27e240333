"""Rows of source tables to labelled requests and prepared records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as tx

#: Shares of wrapped states, cumulative: document, ticket, chat list; else the bare text.
WRAPS = ((0.15, "document"), (0.25, "ticket"), (0.32, "chat"))


def wrap_kind(u: Column) -> Column:
    """Which wrapping a state gets, by a uniform number."""
    kind = F.lit("text")
    for bound, name in reversed(WRAPS):
        kind = F.when(u < bound, name).otherwise(kind)
    return kind


def wrapped_state(text: Column, u: Column, channel_u: Column) -> Column:
    """The state as JSON text: a document, a ticket with a channel, a chat list, or the text as it is."""
    channels = F.array(F.lit("email"), F.lit("chat"), F.lit("web form"))
    channel = F.get(channels, F.floor(channel_u * 3).cast("int"))
    return (
        F.when(u < 0.15, F.to_json(F.struct(text.alias("document"))))
        .when(u < 0.25, F.to_json(F.struct(F.struct(channel.alias("channel"), text.alias("body")).alias("ticket"))))
        .when(u < 0.32, F.to_json(F.array(F.struct(F.lit("customer").alias("role"), text.alias("content")))))
        .otherwise(text)
    )


def described(description: Column, u: Column, p_null: float = 0.3, p_struct: float = 0.1) -> Column:
    """An option's description: left out, as an object, or as text."""
    return F.when(u < p_null, F.lit(None).cast("string")).when(u < p_null + p_struct, F.to_json(F.struct(description.alias("what")))).otherwise(description)


def prepared(rows: DataFrame, source: str, row_id: Column, text: Column, kind: str, names: Sequence[str] | Column, gold: Column, task: str, seed: int) -> DataFrame:
    """Prepared records: record_id, group_id, split, type, keys, gold, task, text_sha256. A gold that is no key stays as valid = false."""
    keys = names if isinstance(names, Column) else F.array(*(F.lit(n) for n in names))
    out = rows.select(F.concat(F.lit(f"{source}/train/"), row_id.cast("string")).alias("record_id"), tx.group_id(F.lit(source), text).alias("group_id"), tx.text_hash(text).alias("text_sha256"), keys.alias("keys"), gold.alias("gold"))
    return out.select("record_id", "group_id", F.lit(source).alias("source_family"), tx.split_of(F.col("group_id"), seed).alias("split"), F.lit(kind).alias("type"), "keys", "gold", F.lit(task).alias("task"), "text_sha256", F.coalesce(F.array_contains("keys", F.col("gold")), F.lit(False)).alias("valid"))


def shuffled(options: Column, key: Column, seed: int) -> Column:
    """Options in an order that depends on the key and the seed alone."""
    ordered = F.array_sort(F.transform(options, lambda o: F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), key, F.lit("|"), o), 256).alias("h"), o.alias("o"))))
    return F.transform(ordered, lambda x: x["o"])
