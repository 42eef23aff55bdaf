"""Shards of equal bytes: size-weighted key samples, quantile splitters, ranges, subdivision.

Rows are ordered by the hash of their text, then by id, so equal texts lie together. Splitters
from a sample cut this order into ranges; ranges that hold too many rows or bytes, or that
straddle the border of two shards, are cut again until they don't. Only splitters and one
line per range reach the driver, both in number proportional to rows / ``RANGE_ROWS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import materialized

#: Rows a range may hold; it is ordered within one task.
RANGE_ROWS = 200_000
#: Sampled keys per range.
SAMPLES = 24
#: Share of a shard that one range across its border may hold; equal texts up to it stay together.
BORDER_SHARE = 0.002
_LOWEST = -(1 << 63)


def measured(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns id, size (UTF-8 bytes + 1; null: 1), text_crc32 (null: as empty) and hash."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key).cast("long").alias("id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.xxhash64(F.col(text)).alias("hash"),
    )


class Splitters:
    """Sorted (hash, id) places; a row's range is the number of places at or before it."""

    def __init__(self, places: list[tuple[int, int]]):
        self.places = sorted(set(places))
        self.hashes = np.array([p[0] for p in self.places], np.int64)
        self.ids = np.array([p[1] for p in self.places], np.int64)

    def find(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.hashes, hashes, side="left")
        high = np.searchsorted(self.hashes, hashes, side="right")
        out = low.copy()
        for at in np.unique(low[high > low]):
            own = np.flatnonzero((low == at) & (high > at))
            out[own] = at + np.searchsorted(self.ids[at : high[own[0]]], ids[own], side="right")
        return out


def ranged(rows: DataFrame, splitters: Splitters) -> DataFrame:
    """Add ``range``, the number of the range each row lies in."""
    found = rows.sparkSession.sparkContext.broadcast(splitters)
    names = rows.columns

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            hashes, ids = (np.asarray(batch.column(c).fill_null(_LOWEST)) for c in ("hash", "id"))
            at = pa.array(found.value.find(hashes, ids), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, at], [*names, "range"])

    return rows.mapInArrow(find, T.StructType([*rows.schema.fields, T.StructField("range", T.LongType())]))


def _sampled(rows: DataFrame, per_byte: Column, seed: int) -> DataFrame:
    """Rows kept with a chance in proportion to their size, and the bytes each stands for."""
    draw = F.pmod(F.xxhash64("hash", "id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chance = F.least(F.col("size") * per_byte, F.lit(1.0))
    return rows.where(draw < chance).select("hash", F.coalesce("id", F.lit(_LOWEST)).alias("id"), (F.col("size") / chance).alias("weight"))


def _quantiles(sample: list[tuple[int, int, float]], parts: int, floor: int | None) -> list[tuple[int, int]]:
    """``parts`` - 1 places at equal weights; before a group of equal texts, or inside it if it is the first."""
    sample = sorted(sample)
    weights = np.cumsum([s[2] for s in sample])
    if not len(weights):
        return []
    at = np.searchsorted(weights, weights[-1] * np.arange(1, parts) / parts)
    return [(h, i if h == floor else _LOWEST) for h, i, _ in (sample[min(x, len(sample) - 1)] for x in at)]


def planned(rows: DataFrame, shards: int, *, range_rows: int = RANGE_ROWS, border: float = BORDER_SHARE) -> tuple[Splitters, list[tuple[int, int]]]:
    """Splitters, and (shard, first slot) of each range.

    The sizes of the shards differ by at most about two border ranges, or by one group of
    rows that are equal in id and text, which can't be told apart.
    """
    n, total = rows.agg(F.count("*"), F.sum("size")).head()
    if not n:
        return Splitters([]), [(0, 0)]
    parts = int(max(16 * shards, -(-n // range_rows) * 2))
    range_rows = min(range_rows, max(1_000, 4 * n // parts))  # ranges of like size, so like tasks
    sample = _sampled(rows, F.lit(parts * SAMPLES / total), 0).collect()
    splitters = Splitters(_quantiles([tuple(s) for s in sample], parts, None))
    for turn in range(1, 64):
        held = ranged(rows, splitters).groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        count = {r["range"]: (r["n"], r["bytes"]) for r in held.collect()}
        over, before = [], 0
        for at in range(len(splitters.places) + 1):
            own_rows, own = count.get(at, (0, 0))
            split = before * shards // total != max(before, before + own - 1) * shards // total
            if own_rows > 1 and (own_rows > range_rows or split and own > border * total / shards):
                over.append(at)
            before += own
        if not over:
            break
        bytes_of = {at: count[at][1] for at in over}
        rates = F.create_map(*[F.lit(x) for at in over for x in (at, 16 * SAMPLES / bytes_of[at])])
        inside = ranged(rows, splitters).where(F.col("range").isin(over)).withColumn("rate", rates[F.col("range")])
        drawn: dict[int, list] = {at: [] for at in over}
        for s in ranged(_sampled(inside, F.col("rate"), turn), splitters).collect():
            drawn[s["range"]].append((s["hash"], s["id"], s["weight"]))
        new = list(splitters.places)
        for at, own in drawn.items():
            floor = splitters.places[at - 1][0] if at else None
            if own and len({h for h, _, _ in own}) == 1:
                floor = own[0][0]  # what was drawn is one group: cut before it and inside it
                new.append((floor, _LOWEST))
            new += _quantiles(own, 16, floor)
        finer = Splitters(new)
        if len(finer.places) == len(splitters.places):
            break  # what is left are rows equal in id and text
        splitters = finer
    place, before, slots = [], 0, [0] * shards
    for at in range(len(splitters.places) + 1):
        own_rows, own = count.get(at, (0, 0))
        shard = int(min(shards - 1, (2 * before + own) * shards // (2 * total)))
        place.append((shard, slots[shard]))
        slots[shard] += own_rows
        before += own
    return splitters, place


def sharded(df: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: id, size, text_crc32, hash, shard, and slot (gapless from 0 in each shard).

    The law is equal bytes. A null text has size 1, a null id comes first, rows equal in id
    and text share a range and get slots in any order; an empty table has no rows.
    """
    rows = materialized(measured(df, key=key, text=text), "shard-sizes")
    splitters, place = planned(rows, shards, range_rows=range_rows)
    where = df.sparkSession.createDataFrame(
        [(i, s, o) for i, (s, o) in enumerate(place)], "range long, shard int, first_slot long"
    )
    order = Window.partitionBy("range").orderBy("hash", "id")
    rows = ranged(rows, splitters).withColumn("nth", F.row_number().over(order) - 1)
    rows = rows.join(F.broadcast(where), "range")  # a line per range, as many as the driver has just made
    return rows.select("id", "size", "text_crc32", "hash", "shard", (F.col("first_slot") + F.col("nth")).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int, *, key: str = "doc_id", text: str = "text") -> None:
    """Write ``df`` in one folder per shard; a task holds one range, in slot order by hash and id."""
    if clash := {"hash", "id", "size", "text_crc32", "range", "shard"} & set(df.columns):
        df = df.withColumnsRenamed({c: f"own_{c}" for c in clash})
    key, text = (f"own_{c}" if c in clash else c for c in (key, text))
    sizes = materialized(measured(df, key=key, text=text), "shard-sizes")
    splitters, place = planned(sizes, shards)
    full = df.withColumns({"hash": F.xxhash64(F.col(text)), "id": F.col(key).cast("long")})
    shard = F.element_at(F.array(*[F.lit(s) for s, _ in place]), (F.col("range") + 1).cast("int"))
    rows = ranged(full, splitters).withColumn("shard", shard).repartition(len(place), "range")
    rows = rows.sortWithinPartitions("range", "hash", "id").drop("range", "hash", "id")
    rows.write.partitionBy("shard").parquet(path)
