"""Hard negatives: near rows of other labels, in a window below each positive's score.

Rows are put in the order of a Hilbert curve through their most varied dimensions, within
their label, and cut into blocks: one Parquet row a block, with the smallest and largest
value of every dimension and of the label beside the vectors. Interval arithmetic on these
zone maps gives bounds of an anchor's scores in a block, and only blocks whose bounds meet one
of its windows are read. A first pass reads each anchor's most promising block, which raises the
floors of its windows; the second reads what the bounds still don't exclude, so nothing is
lost. Anchors are cut into blocks of their own; a task compares one block of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import batches as B
from flowlens.session import materialized

#: Numbers in the vectors of a block of rows, and of anchors; rows in a block at most; zone maps compared at a time.
BLOCK_NUMBERS, ANCHOR_NUMBERS, ROWS, ZONES = 262_144, 65_536, 8_192, 2_048
#: Dimensions of the curve, and bits of each.
DIMENSIONS, BITS = 15, 4
#: Components are counted in so many parts of one.
SCALE = 256
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Not null, and no null or non-finite component."""
    number = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Each row's place on the Hilbert curve through a grid of 2 ** ``bits`` cells a side."""
    x = cells.astype(np.int64).T.copy()
    if not len(x):
        return np.zeros(cells.shape[0], np.int64)
    level = 1 << bits - 1
    while level > 1:
        below = level - 1
        for i in range(len(x)):
            turned = (x[i] & level) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << bits - 1
    while level > 1:
        flip ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | row >> bit & 1
    return place


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; beyond 64 bits the nearest 64-bit integer."""
    largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if largest < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    whole = a.astype(object) @ b.T.astype(object) if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(whole, _LOWEST, _HIGHEST).astype(np.int64)


_BLOCK = (
    "block long, dim int, n int, ids array<long>, labels array<long>, numbers array<long>, "
    "low array<long>, high array<long>, label_low long, label_high long"
)


def _block(held: list[pa.RecordBatch], dim: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    numbers = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows.num_rows, dim)
    labels = rows.column("label").to_numpy()
    values = [
        rows.column("row")[0].as_py(), dim, rows.num_rows, rows.column("id").to_numpy(), labels, numbers.reshape(-1),
        numbers.min(axis=0), numbers.max(axis=0), int(labels.min()), int(labels.max()),
    ]
    names = [c.split(" ")[0] for c in _BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 5, pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def blocks(rows: DataFrame, numbers: int, name: str) -> DataFrame:
    """``rows`` (id, label, dim, vector, curve) as a table of blocks, along the curve within labels."""
    order = ["dim", "label", "curve", "id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, dim = [], 0, -1
        for batch in parts:
            dims = batch.column("dim").to_numpy()
            at = 0
            while at < batch.num_rows:
                if dims[at] != dim and held:
                    yield _block(held, dim)
                    held, size = [], 0
                dim = int(dims[at])
                most = min(ROWS, max(64, numbers // max(1, dim)))
                stop = min(at + most - size, int(np.searchsorted(dims, dim, side="right")))
                held.append(batch.slice(at, stop - at))
                size, at = size + stop - at, stop
                if size == most:
                    yield _block(held, dim)
                    held, size = [], 0
        if held:
            yield _block(held, dim)

    return materialized(dealt.mapInArrow(cut, _BLOCK), name)


def _along_curve(rows: DataFrame) -> DataFrame:
    """``rows`` (id, label, vector) with dim and curve; cells are equal steps between a dimension's extremes."""
    rows = rows.withColumn("dim", F.size("vector"))
    spread = rows.select("dim", F.posexplode("vector").alias("at", "x")).groupBy("dim", "at")
    # one row for each dimension of each length of vector
    spread = spread.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.var_pop("x").alias("spread"))
    best = Window.partitionBy("dim").orderBy(F.desc("spread"), "at")
    some = spread.withColumn("k", F.row_number().over(best)).where(F.col("k") <= DIMENSIONS)
    axes = {}
    for r in some.orderBy("dim", "k").collect():
        axes.setdefault(r["dim"], []).append((r["at"], r["low"], r["high"]))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            dims = batch.column("dim").to_numpy()
            curve = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                if dim:
                    x = batch.column("vector").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
                    at, low, high = np.array(axes[dim], np.float64).T
                    cell = (x[:, at.astype(np.int64)] - low) / np.maximum(high - low, 1) * ((1 << BITS) - 1)
                    curve[own] = hilbert(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64), BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve)], [*batch.schema.names, "curve"])

    return rows.mapInArrow(place, "id long, label long, vector array<long>, dim int, curve long")


class Anchors:
    """A block of anchors and their windows, as arrays: one row a window."""

    def __init__(self, row: dict):
        self.ids = np.array(row["ids"], np.int64)
        self.labels = np.array(row["labels"], np.int64)
        self.vectors = np.array(row["numbers"], np.int64).reshape(len(self.ids), row["dim"])
        windows = row["windows"]
        order = np.argsort(self.ids, kind="stable")
        self.anchor = order[np.searchsorted(self.ids[order], np.array([w["anchor"] for w in windows], np.int64))]
        self.place = np.array([w["place"] for w in windows], np.int64)
        self.least = np.array([w["least"] for w in windows], np.int64)
        self.most = np.array([w["most"] for w in windows], np.int64)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score each anchor can have in each block, by interval arithmetic."""
        up, down = np.maximum(self.vectors, 0).astype(np.float64), np.minimum(self.vectors, 0).astype(np.float64)
        low, high = low.T.astype(np.float64), high.T.astype(np.float64)
        # what the sums of products beyond 53 bits can be wrong by
        slack = np.abs(self.vectors).astype(np.float64) @ np.maximum(np.abs(low), np.abs(high)) * 1e-9
        slack[slack < 2**22] = 0
        return up @ low + down @ high - slack, up @ high + down @ low + slack


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, lists of numbers as arrays."""
    plain = [pa.types.is_list(f.type) and pa.types.is_integer(f.type.value_type) for f in batch.schema]
    for i in range(batch.num_rows):
        parts = [c.slice(i, 1) for c in batch.columns]
        yield {
            f.name: c.flatten().to_numpy() if flat else c[0].as_py() for f, c, flat in zip(batch.schema, parts, plain, strict=True)
        }


_CELLS = "block long, asked long"


def _cells(asked: DataFrame, zones: DataFrame, chunks: int, same: bool, first: bool) -> DataFrame:
    """(block, asked): the blocks each block of anchors must read; with ``first`` each anchor's most promising one of a chunk."""
    spread = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(zones, ["dim", "chunk"])

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in _each(batch):
                own, zone = Anchors(row), row["zones"]
                low, high = (np.array([z[c] for z in zone], np.int64).reshape(len(zone), row["dim"]) for c in ("low", "high"))
                least, most = own.bounds(low, high)
                a, b = (np.array([z[c] for z in zone], np.int64)[None] for c in ("label_low", "label_high"))
                label = own.labels[:, None]
                fits = (a <= label) & (label <= b) if same else (a != label) | (b != label)
                meets = fits[own.anchor] & (most[own.anchor] >= own.least[:, None]) & (least[own.anchor] <= own.most[:, None])
                if first:  # of the blocks that meet a window, the one of highest bound
                    value = np.where(meets, most[own.anchor], -np.inf)
                    best = value.argmax(axis=1)
                    found = np.unique(best[np.isfinite(value[np.arange(len(best)), best])]) if len(best) else best
                else:
                    found = np.flatnonzero(meets.any(axis=0))
                names = np.array([z["block"] for z in zone], np.int64)[found]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), row["asked"], np.int64))], ["block", "asked"])

    return spread.mapInArrow(choose, _CELLS)


_FOUND = "anchor long, place int, id long, score long"


def _tile(own: Anchors, row: dict, same: bool, k: int) -> list[np.ndarray]:
    """The first k rows of a block in each window: window, row, score."""
    ids, labels = np.array(row["block_ids"], np.int64), np.array(row["block_labels"], np.int64)
    scores = products(own.vectors, np.array(row["block_numbers"], np.int64).reshape(len(ids), row["dim"]))
    by_id = np.argsort(ids, kind="stable")
    ids, labels, scores = ids[by_id], labels[by_id], scores[:, by_id]
    out = []
    order = np.argsort(own.anchor, kind="stable")
    cuts = np.flatnonzero(np.r_[True, own.anchor[order][1:] != own.anchor[order][:-1]]) if len(order) else order
    for windows in np.split(order, cuts[1:]) if len(order) else []:
        anchor = own.anchor[windows[0]]
        score = scores[anchor]
        use = (ids != own.ids[anchor]) & ((labels == own.labels[anchor]) == same)
        use &= (score >= own.least[windows].min()) & (score <= own.most[windows].max())
        rows = np.flatnonzero(use)
        rows = rows[np.argsort(score[rows], kind="stable")]  # ascending; of equal scores the larger ids must come first
        value = score[rows]
        for w in windows.tolist():
            a = np.searchsorted(value, own.least[w], side="left")
            b = np.searchsorted(value, own.most[w], side="right")
            if b > a:
                # all rows of the k-th score, then the smaller ids of them
                a = max(a, np.searchsorted(value, value[max(a, b - k)], side="left"))
                some = rows[a:b]
                some = some[np.lexsort((ids[some], -score[some]))][:k]
                out.append(np.stack([np.full(len(some), w), ids[some], score[some]]))
    return out


def _search(asked: DataFrame, cells: DataFrame, table: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor, place, id, score: the first k rows of each window in each cell."""
    payload = table.select("block", *[F.col(c).alias(f"block_{c}") for c in ("ids", "labels", "numbers")])
    joined = cells.join(asked, "asked").join(payload, "block")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in _each(batch):
                own = Anchors(row)
                found = _tile(own, row, same, k)
                if found:
                    window, ids, score = np.concatenate(found, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.ids[own.anchor[window]]), pa.array(own.place[window].astype(np.int32)), pa.array(ids), pa.array(score)],
                        ["anchor", "place", "id", "score"],
                    )

    return joined.mapInArrow(compare, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _windowed(groups: DataFrame, owners: DataFrame, windows: DataFrame) -> DataFrame:
    """Blocks of anchors with their windows (anchor, place, least, most)."""
    lists = windows.join(owners, "anchor").groupBy("asked").agg(F.collect_list(F.struct("anchor", "place", "least", "most")).alias("windows"))
    return groups.select(F.col("block").alias("asked"), "dim", "ids", "labels", "numbers").join(lists, "asked")


def _in_windows(groups: DataFrame, owners: DataFrame, windows: DataFrame, table: DataFrame, zones: DataFrame, chunks: int, same: bool, k: int) -> DataFrame:
    """The first k rows of each window over all blocks: anchor, place, id, score, rank."""
    asked = materialized(_windowed(groups, owners, windows), "negatives-asked")
    cells = materialized(_cells(asked, zones, chunks, same, True).distinct(), "negatives-cells")
    found = materialized(_search(asked, cells, table, same, k), "negatives-found")
    # the k-th score so far is the floor of what else can count
    floors = _first(found, k).where(F.col("rank") == k).select("anchor", "place", F.col("score").alias("floor"))
    raised = windows.join(floors, ["anchor", "place"], "left").withColumn("least", F.greatest("least", "floor"))
    asked = materialized(_windowed(groups, owners, raised.drop("floor")), "negatives-asked")
    more = _cells(asked, zones, chunks, same, False).join(cells, ["block", "asked"], "left_anti")
    more = _search(asked, more, table, same, k)
    return materialized(_first(found.unionByName(more), k), "negatives-first")


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 10, shares: tuple[int, int] = (30, 90),
    key: str = "vec_id", vector: str = "embedding", label: str = "label", numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(256 x) (at most what a long holds), a score is the inner product.
    An anchor's positives are its first rows of the same label, higher scores and then smaller
    ids first. For each positive the first rows of other labels follow whose score is between
    ``shares`` per cent of the positive's. Rows with a null id, label or vector, or a null or
    non-finite component take no part; vectors of different lengths aren't compared. Rows of
    the anchor's id are the anchor itself; of several anchors of one id the smallest label and
    vector count, while repeated rows each count. Other columns play no part.
    """

    def valid(df: DataFrame) -> DataFrame:
        df = df.where(B.name(key).isNotNull() & B.name(label).isNotNull() & finite(B.name(vector)))
        whole = F.transform(B.name(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
        return df.select(B.name(key).cast("long").alias("id"), B.name(label).cast("long").alias("label"), whole.alias("vector"))

    curved = _along_curve(valid(rows))
    table = blocks(curved, numbers, "negatives-blocks")
    one = valid(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")
    groups = blocks(_along_curve(one), max(1, numbers * ANCHOR_NUMBERS // BLOCK_NUMBERS), "negatives-anchors")
    owners = groups.select(F.col("block").alias("asked"), F.explode("ids").alias("anchor"))
    chunks = table.count() // ZONES + 1
    zone = F.struct("block", "low", "high", "label_low", "label_high")
    zones = table.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))
    zones = materialized(zones.groupBy("dim", "chunk").agg(F.collect_list(zone).alias("zones")), "negatives-zones")
    every = owners.select("anchor", F.lit(0).alias("place"), F.lit(_LOWEST).alias("least"), F.lit(_HIGHEST).alias("most"))
    near = _in_windows(groups, owners, every, table, zones, chunks, True, positives)
    near = near.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    wide = F.col("positive_score").cast("decimal(20,0)")
    least, most = F.ceil(wide * shares[0] / 100), F.floor(wide * shares[1] / 100)
    windows = near.select("anchor", "place", least.cast("long").alias("least"), most.cast("long").alias("most")).where(F.col("least") <= F.col("most"))
    found = _in_windows(groups, owners, windows, table, zones, chunks, False, negatives)
    return found.join(near, ["anchor", "place"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
