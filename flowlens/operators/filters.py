"""Packet filters: rule lists, rule tables, and the display filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import materialized

RULE_TABLE_BROADCAST_ROWS = 100_000
RULE_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


class Rule(NamedTuple):
    """One filter rule; ``type`` is ``ip``, ``port`` or ``protocol``."""

    type: str
    field: str
    value: object


def add_rule(rules: Sequence[Rule], rule: Rule) -> list[Rule]:
    return [*rules, rule]


def remove_rule(rules: Sequence[Rule], rule: Rule) -> list[Rule]:
    """The list without the first equal rule; unchanged where there is none."""
    left = list(rules)
    if rule in left:
        left.remove(rule)
    return left


def clear_rules(rules: Sequence[Rule]) -> list[Rule]:
    return []


def rule_predicate(df: DataFrame, rules: Sequence[Rule]) -> Column | None:
    """Rules OR-ed into plain comparisons, which reach the parquet scan.

    None means "no rules, all pass". Types are compared strictly: a text value never
    equals a numeric column.
    """
    if not rules:
        return None
    return reduce(or_, [_matches(df, Rule(*rule)) for rule in rules])


def _matches(df: DataFrame, rule: Rule) -> Column:
    if rule.type not in ("ip", "port", "protocol"):
        return F.lit(False)
    name = "protocol" if rule.type == "protocol" else rule.field
    if name not in df.columns:
        return F.lit(False)
    kind = df.schema[name].dataType
    text_column = isinstance(kind, T.StringType)
    if text_column != isinstance(rule.value, str):
        return F.lit(False)
    return F.col(name) == F.lit(rule.value)


def rule_filter(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Packets matching any rule."""
    predicate = rule_predicate(df, rules)
    return df if predicate is None else df.where(predicate)


def rule_table_filter(
    packets: DataFrame, rules: DataFrame, broadcast_rows: int = RULE_TABLE_BROADCAST_ROWS
) -> DataFrame:
    """Packets matching any row of a ``(type, field, value)`` text table; values are compared as text.

    The rules are computed once and kept as a table. An empty table means that all packets pass, one
    without any rule that can match that none does. Fields are looked up by broadcast, those of few
    rules first, while their rules together are at most ``broadcast_rows``; then no packet is
    shuffled. The values of the other fields meet the rules in one join: of the packets only the
    distinct combinations of these fields go there, as (field, value) pairs, and the combinations
    found choose the packets in a second join. No packet row is multiplied.
    """
    fields = [name for name in RULE_FIELDS if name in packets.columns]
    field = F.when(F.col("type") == "protocol", F.lit("protocol")).otherwise(F.col("field"))
    field = F.when(F.col("type").isin("ip", "port", "protocol") & field.isin(fields), field)
    known = materialized(rules.select(field.alias("_field"), F.col("value").alias("_value")).distinct(), "rules")
    sizes = {r["_field"]: r["n"] for r in known.groupBy("_field").agg(F.count("_value").alias("n")).collect()}
    if not sizes:
        return packets
    known = known.where(F.col("_field").isNotNull() & F.col("_value").isNotNull())
    kept, hits, room, large = packets, [], broadcast_rows, []
    for name in sorted((f for f in fields if sizes.get(f)), key=lambda f: sizes[f]):
        room -= sizes[name]
        if room < 0:
            large.append(name)
            continue
        side = known.where(F.col("_field") == name).select(F.col("_value").alias(f"_value_{name}"))
        kept = kept.join(F.broadcast(side), F.col(name).cast("string") == F.col(f"_value_{name}"), "left")
        hits.append(F.col(f"_value_{name}").isNotNull())
    if large:
        found = _matching_combinations(packets.select(*large), known)
        same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in large])
        kept = kept.join(found, same, "left")
        hits.append(F.col("_found").isNotNull())
    return kept.where(reduce(or_, hits, F.lit(False))).select(*packets.columns)


def _matching_combinations(packets: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct rows of which some field's text is among the known ``(_field, _value)``, marked."""
    names = packets.columns
    pairs = [F.struct(F.lit(c).alias("_field"), F.col(c).cast("string").alias("_value")) for c in names]
    apart = packets.distinct().select("*", F.inline(F.array(*pairs)))
    found = apart.join(known, ["_field", "_value"], "left_semi").select(*names).distinct()
    return found.select(*[F.col(c).alias(f"_of_{c}") for c in names], F.lit(True).alias("_found"))


def has_flag(df: DataFrame, name: str, bit: int) -> Column:
    """A TCP flag from its boolean column, or from the bits of ``tcp_flags``."""
    if name in df.columns:
        return F.coalesce(F.col(name), F.lit(False))
    if "tcp_flags" in df.columns:
        return F.coalesce(F.col("tcp_flags").bitwiseAND(bit) != 0, F.lit(False))
    return F.lit(False)


def syn_only(df: DataFrame) -> Column:
    """TCP with SYN set and ACK clear."""
    syn, ack = has_flag(df, "tcp_syn", 0x02), has_flag(df, "tcp_ack_flag", 0x10)
    return (F.col("protocol") == "tcp") & syn & ~ack


def alerts(detections: DataFrame) -> DataFrame:
    """Detections whose prediction is anything but ``normal``."""
    return detections.where(F.col("prediction") != "normal")


def display_filter(
    df: DataFrame,
    text: str | None = None,
    ip_protocol: int | None = None,
    severity: str | None = None,
    cutoffs: tuple[float, float] | None = None,
    columns: Sequence[str] = ("src_ip", "dst_ip", "protocol"),
) -> DataFrame:
    """Free text over the shown columns, IP protocol number, and severity by confidence.

    ``cutoffs`` are the lowest confidences of ``medium`` and ``high``; they have no default.
    """
    if text:
        shown = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
        df = df.where(F.contains(F.lower(shown), F.lit(text.lower())))
    if ip_protocol is not None:
        df = df.where(F.col("ip_protocol") == ip_protocol)
    if severity not in (None, "all"):
        if cutoffs is None:
            raise ValueError("severity needs cutoffs=(medium, high)")
        df = df.where(severity_of(F.col("confidence"), cutoffs) == severity)
    return df


def severity_of(confidence: Column, cutoffs: tuple[float, float]) -> Column:
    medium, high = cutoffs
    return (
        F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")
    )
