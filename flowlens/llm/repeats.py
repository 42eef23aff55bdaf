"""Bytes that an earlier text already holds, found with a logarithmic family of suffix arrays.

A window (100 bytes) belongs to its anchor, the 32-byte gram of lowest hash in it, so equal
windows have equal anchors. The windows that share one anchor in a row form a piece. A first
shuffle, of prints only, finds pieces that are equal as a whole, and those whose anchor occurs
in other pieces too. Only the latter are sent as text, again by anchor; there their suffixes
enter the index: each batch gets a suffix array, its suffixes are searched for in the arrays
of the levels before it, and levels of like size merge, so a level holds twice the one below.

Equal pieces within a slice of text are sent once, and an anchor with many different pieces in
one slice is sent on at once and divided by window, so no anchor gathers more than a few rows
per slice in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import batches as B
from flowlens.session import materialized

GRAM = 32
#: Bytes of text per bucket of texts or anchors.
BUCKET_BYTES = 2 << 20
#: Different pieces of one anchor in a slice, or in a bucket, from which its windows are sent one by one.
SLICE_PIECES, BUCKET_PIECES = 8, 2_000
#: Bytes of the pieces that get one suffix array.
BATCH_BYTES = 256 << 10
SEEN, WANTED, DIVIDED = 1, 2, 3
_MARKS = "bucket int, kind int, doc array<long>, tie array<int>, start array<int>, size array<int>, gram array<long>"
_PIECES = "bucket int, doc array<long>, tie array<int>, start array<int>, piece array<binary>"


def anchors(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, print of the anchor and print of each piece."""
    empty = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    if n < window:
        return empty
    prints = B.Fingerprints(data)
    places = np.arange(n - GRAM + 1)
    grams = B.mix(prints.spans(places, places + GRAM))
    best = grams >> np.uint64(32) << np.uint64(32) | places.astype(np.uint64)
    width, reach = window - GRAM + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        best = np.minimum(best[: len(best) - step], best[step:])
        reach += step
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    fits = row[: len(best)] == row[window - 1 : window - 1 + len(best)]
    first_of = np.flatnonzero(fits)
    if not len(first_of):
        return empty
    anchor = (best[first_of] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (first_of[1:] != first_of[:-1] + 1)]
    start = first_of[fresh]
    count = np.diff(np.r_[np.flatnonzero(fresh), len(first_of)])
    middle = anchor[fresh]
    shape = ((middle - start) << 32 | count).astype(np.uint64)
    whole = B.mix(prints.spans(start, start + count + window - 1) ^ B.mix(shape))
    return row[start], start - at[row[start]], count, grams[middle], whole


def _rows(schema: pa.Schema, bucket: np.ndarray, fixed: dict[str, int], lists: dict[str, pa.Array]) -> pa.RecordBatch:
    """One row per bucket, with lists of the values that belong to it."""
    order = np.argsort(bucket, kind="stable")
    own, at = np.unique(bucket[order], return_index=True)
    places = np.r_[at, len(bucket)]
    columns = []
    for field in schema:
        if field.name == "bucket":
            columns.append(pa.array(own, pa.int32()))
        elif field.name in fixed:
            columns.append(pa.array([fixed[field.name]] * len(own), field.type))
        elif field.name in lists:
            columns.append(B.list_array(lists[field.name].take(pa.array(order)).cast(field.type.value_type), places))
        else:
            columns.append(pa.array([[]] * len(own), field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.rsplit(" ", 1) for f in ddl.split(", ")]
    return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]) for n, k in fields])


def _repeated(new: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Entries that follow the first of their group at another place."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return ~new & np.any([x != x[first] for x in place], axis=0)


_SENT = "bucket int, kind int, gram array<long>, whole array<long>, doc array<long>, tie array<int>, start array<int>, size array<int>"


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (B.mix(values.view(np.uint64) if values.dtype == np.int64 else values) % np.uint64(buckets)).astype(np.int64)


def _first(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the first one first, and where a new pair of the first two begins."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return order, new


def _sent(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """Prints of the pieces by anchor, and what a slice can tell by itself, by text."""
    schema = _arrow(_SENT)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.slices(parts, "text"):
            data, at = B.text_bytes(rows.column("text"))
            row, start, count, gram, whole = anchors(data, at, window)
            if not len(row):
                continue
            doc, tie = (np.asarray(rows.column(c))[row] for c in ("id", "tie"))
            order, new = _first(gram, whole, doc, tie, start)
            row, start, count, gram, whole, doc, tie = (x[order] for x in (row, start, count, gram, whole, doc, tie))
            # how many different pieces the anchor has in this slice
            fresh = np.r_[True, gram[1:] != gram[:-1]]
            group = np.cumsum(fresh) - 1
            many = np.bincount(group, new)[group] >= SLICE_PIECES
            lists = {"doc": doc, "tie": tie, "start": start, "size": count, "gram": gram.view(np.int64), "whole": whole.view(np.int64)}
            for kind, own in ((0, new & ~many), (SEEN, _repeated(new, doc, tie, start)), (DIVIDED, new & many)):
                if own.any():
                    bucket = _bucket(gram[own], buckets) if kind == 0 else _bucket(doc[own], buckets)
                    yield _rows(schema, bucket, {"kind": kind}, {k: pa.array(v[own]) for k, v in lists.items() if kind != SEEN or k not in ("gram", "whole")})
            told = fresh & many
            if told.any():  # a piece of size 0 tells the others that this anchor is divided
                values = {k: pa.array(v[told]) for k, v in lists.items()} | {"size": pa.array(np.zeros(told.sum(), np.int64))}
                yield _rows(schema, _bucket(gram[told], buckets), {"kind": 0}, values)

    return texts.mapInArrow(send, _SENT)


def _flat(table: pa.Table, name: str, kind: type) -> np.ndarray:
    values = table.column(name).combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return np.asarray(values.flatten()).astype(kind, copy=False)


def _settled(sent: DataFrame, buckets: int) -> DataFrame:
    """Marks by text: pieces seen before as a whole, pieces whose text is wanted, and those to divide."""
    schema = _arrow(_MARKS)

    def settle(table: pa.Table) -> pa.Table:
        B.release()
        out = []
        for kind in (SEEN, DIVIDED):
            own = table.filter(pa.compute.equal(table.column("kind"), kind))
            if own.num_rows:
                out += own.select(schema.names).cast(schema).to_batches()
        own = table.filter(pa.compute.equal(table.column("kind"), 0))
        names = {"gram": np.int64, "whole": np.int64, "doc": np.int64, "tie": np.int64, "start": np.int64, "size": np.int64}
        gram, whole, doc, tie, start, size = (_flat(own, k, v) for k, v in names.items())
        if len(gram):
            _, back, n = np.unique(gram, return_inverse=True, return_counts=True)
            keep = n[back] > 1
            gram, whole, doc, tie, start, size = (x[keep] for x in (gram, whole, doc, tie, start, size))
        if len(gram):
            whole = np.where(size == 0, np.int64(0), whole)
            order, new = _first(gram, whole, doc, tie, start)
            gram, whole, doc, tie, start, size = (x[order] for x in (gram, whole, doc, tie, start, size))
            group = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
            real = size > 0
            pieces = np.bincount(group, new & real)
            told = np.bincount(group, ~real) > 0
            divided = (told | (pieces > BUCKET_PIECES))[group]
            wanted = (pieces > 1)[group]
            lists = {"doc": doc, "tie": tie, "start": start, "size": size, "gram": gram}
            for kind, pick in ((SEEN, real & _repeated(new, doc, tie, start)), (WANTED, real & new & wanted & ~divided), (DIVIDED, real & new & divided)):
                if pick.any():
                    values = {k: pa.array(v[pick]) for k, v in lists.items()}
                    out.append(_rows(schema, _bucket(doc[pick], buckets), {"kind": kind}, values))
        return pa.Table.from_batches(out, schema)

    return sent.groupBy("bucket").applyInArrow(settle, _MARKS)


class _Texts:
    """The texts of one bucket, found by id and tie."""

    def __init__(self, table: pa.Table):
        self.doc = table.column("id").to_numpy()
        self.tie = table.column("tie").to_numpy().astype(np.int64)
        text = table.column("text").combine_chunks()
        self.data, self.at = B.text_bytes(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks or [pa.array([], pa.string())]))

    def rows(self, doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The row of each (id, tie); all pairs are in the bucket."""
        pairs = np.unique(np.stack([np.r_[self.doc, doc], np.r_[self.tie, tie]]), axis=1, return_inverse=True)[1].reshape(-1)
        row = np.zeros(pairs.max() + 1, np.int64)
        row[pairs[: len(self.doc)]] = np.arange(len(self.doc))
        return row[pairs[len(self.doc) :]]


def _pieces(texts: DataFrame, marks: DataFrame, window: int, buckets: int) -> DataFrame:
    """The text of wanted pieces by anchor, and of the windows of divided ones by content."""
    schema = _arrow(_PIECES)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        B.release()
        out = []
        if left.num_rows and right.num_rows:
            own = _Texts(left)
            raw = own.data.tobytes()
            for kind in (WANTED, DIVIDED):
                part = right.filter(pa.compute.equal(right.column("kind"), kind))
                if not part.num_rows:
                    continue
                doc, tie, start, size, gram = (_flat(part, k, np.int64) for k in ("doc", "tie", "start", "size", "gram"))
                if kind == DIVIDED:
                    each = np.repeat(np.arange(len(doc)), size)
                    start = start[each] + np.arange(len(each)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
                    doc, tie, size = doc[each], tie[each], np.ones(len(each), np.int64)
                at = own.at[own.rows(doc, tie)] + start
                if kind == DIVIDED:
                    gram = B.Fingerprints(own.data).spans(at, at + window).view(np.int64)
                pieces = pa.array([raw[a:b] for a, b in zip(at.tolist(), (at + size + window - 1).tolist(), strict=True)], pa.binary())
                values = {"doc": pa.array(doc), "tie": pa.array(tie), "start": pa.array(start), "piece": pieces}
                out.append(_rows(schema, _bucket(gram, buckets), {}, values))
        return pa.Table.from_batches(out, schema)

    wanted = marks.where(F.col("kind") != SEEN)
    return texts.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(cut, _PIECES)


def suffix_order(data: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the given places by their first ``depth`` bytes: order, and whether each differs from the one before."""
    padded = np.r_[data, np.zeros(depth, np.uint8)].astype(np.uint64)
    n, reach = len(data), min(8, depth)
    first = np.zeros(n, np.uint64)
    for i in range(reach):
        first = first << np.uint64(8) | padded[i : i + n]
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    while reach * 2 <= depth:
        rank = _paired(rank, reach)
        reach *= 2
    if reach < depth:
        rank = _paired(rank, depth - reach)
    own = rank[start]
    order = np.argsort(own, kind="stable")
    sorted_ = own[order]
    return order, np.r_[True, sorted_[1:] != sorted_[:-1]] if len(order) else np.zeros(0, bool)


def _paired(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks by (rank here, rank ``step`` places on)."""
    ahead = np.zeros(len(rank), np.int64)
    ahead[: max(0, len(rank) - step)] = rank[step:] + 1
    return np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)


class Levels:
    """Sorted arrays of distinct windows; a level is at least twice as large as the one after it."""

    def __init__(self, window: int):
        self.window = window
        self.levels: list[np.ndarray] = []

    def add(self, pieces: list[bytes]) -> np.ndarray:
        """Take a batch of pieces; tell for each of their windows, in order, whether it came before."""
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        counts = sizes - self.window + 1
        start = np.repeat(ends - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        order, new = suffix_order(data, start, self.window)
        seen = np.zeros(len(start), bool)
        seen[order[~new]] = True
        first = order[new]  # the earliest of equal windows, as the order is stable
        # no byte of UTF-8 is 255, so one more keeps the order and leaves no zero for padding
        keys = np.ascontiguousarray((data + np.uint8(1))[start[first][:, None] + np.arange(self.window)])
        keys = keys.view(f"S{self.window}").reshape(-1)
        known = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            known |= level[at] == keys
        seen[first[known]] = True
        fresh = keys[~known]
        if len(fresh):
            while self.levels and len(self.levels[-1]) < 2 * len(fresh):
                fresh = np.sort(np.concatenate([self.levels.pop(), fresh]), kind="stable")
            self.levels.append(fresh)
        return seen


def _found(pieces: DataFrame, window: int, buckets: int) -> DataFrame:
    """Marks of the windows that an earlier piece holds; joined where they follow each other."""
    schema = _arrow(_MARKS)

    def find(table: pa.Table) -> pa.Table:
        B.release()
        doc, tie, start = (_flat(table, k, np.int64) for k in ("doc", "tie", "start"))
        parts = table.column("piece").combine_chunks()
        parts = (pa.concat_arrays(parts.chunks) if isinstance(parts, pa.ChunkedArray) else parts).flatten()
        order = np.lexsort((start, tie, doc))
        doc, tie, start = doc[order], tie[order], start[order]
        once = np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1])][: len(doc)]
        doc, tie, start, order = doc[once], tie[once], start[once], order[once]
        texts = parts.take(pa.array(order)).to_pylist()
        levels, at, marks = Levels(window), 0, []
        sizes = np.array([len(p) for p in texts])
        ends = np.cumsum(sizes)
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")))
            seen = levels.add(texts[at:stop])
            counts = sizes[at:stop] - window + 1
            each = np.repeat(np.arange(at, stop), counts)
            place = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
            each, place = each[seen], place[seen]
            if len(each):
                fresh = np.flatnonzero(np.r_[True, (each[1:] != each[:-1]) | (place[1:] != place[:-1] + 1)])
                marks.append((doc[each[fresh]], tie[each[fresh]], place[fresh], np.diff(np.r_[fresh, len(each)])))
            at = stop
        if not marks:
            return pa.Table.from_batches([], schema)
        doc, tie, start, size = (np.concatenate(x) for x in zip(*marks, strict=True))
        values = {"doc": pa.array(doc), "tie": pa.array(tie), "start": pa.array(start), "size": pa.array(size)}
        return pa.Table.from_batches([_rows(schema, _bucket(doc, buckets), {"kind": SEEN}, values)], schema)

    return pieces.groupBy("bucket").applyInArrow(find, _MARKS)


@B.any_names
def repeated_spans(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 100, keep_text: bool = True,
    out: str = "repeats",
) -> DataFrame:
    """Add a struct: n_bytes, spans (start, end in bytes), kept_sha256 of the bytes outside them.

    A byte is in a span if a ``window``-byte string over it also starts earlier: in a text of
    smaller id, or before in the same text; spans are maximal. Null texts are empty. Rows of
    one id are ordered by the checksum of their texts; rows equal in both count as one and
    get the same spans. A null id comes first. An existing ``out`` is replaced.
    """
    df = documents.drop(out)
    size = F.coalesce(F.octet_length(text), F.lit(0))
    ids = df.select(F.col(key).alias("k"), size.alias("n")).groupBy("k").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    most, total = ids.agg(F.max("rows"), F.sum("n")).head()
    buckets = int(max(24, (total or 0) // BUCKET_BYTES))
    check = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")) - F.lit(1 << 31)
    tie = check.cast("int") if (most or 0) > 1 else F.lit(0)
    number = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    texts = df.select(number.alias("id"), tie.alias("tie"), F.col(text).alias("text"))

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            bucket = pa.array(_bucket(np.asarray(rows.column("id")), buckets), pa.int32())
            yield pa.RecordBatch.from_arrays([*rows.columns, bucket], [*rows.schema.names, "bucket"])

    def with_bucket(frame: DataFrame) -> DataFrame:
        return frame.mapInArrow(placed, T.StructType([*frame.schema.fields, T.StructField("bucket", T.IntegerType())]))

    marks = materialized(_settled(_sent(texts, window, buckets), buckets), "repeat-marks")
    others = [f for f in df.schema.fields if f.name != text]
    # Pieces and spans meet the same rows, each text in them once, so that one shuffle serves both.
    rows = with_bucket(df.select(F.struct(*[f.name for f in others]).alias("row"), number.alias("id"), tie.alias("tie"), F.col(text).alias("text")))
    found = _found(_pieces(rows, marks, window, buckets), window, buckets)
    seen = marks.where(F.col("kind") == SEEN).unionByName(found)
    result = T.StructType([
        T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("kept_sha256", T.StringType()),
    ])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        B.release()
        texts = _Texts(left)
        doc, tie, start, size = (_flat(right, k, np.int64) for k in ("doc", "tie", "start", "size"))
        cover = np.zeros(len(texts.data), bool)
        if len(doc) and len(texts.doc):
            pairs = texts.rows(doc, tie)
            for extra in _alike(texts):  # rows equal in id and text
                at = texts.at[extra[pairs]] + start
                cover |= B.covered(at, at + size + window - 1, len(texts.data))
        raw = texts.data.tobytes()
        hits = []
        for a, b in zip(texts.at[:-1], texts.at[1:], strict=True):
            if not cover[a:b].any():
                hits.append({"n_bytes": b - a, "spans": [], "kept_sha256": hashlib.sha256(raw[a:b]).hexdigest()})
                continue
            own = np.diff(np.r_[False, cover[a:b], False].astype(np.int8))
            begins, ends = np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist()
            kept = b"".join(raw[a + x : a + y] for x, y in zip([0, *ends], [*begins, b - a], strict=True))
            spans = [{"start": x, "end": y} for x, y in zip(begins, ends, strict=True)]
            hits.append({"n_bytes": b - a, "spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()})
        kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept_sha256", pa.string())])
        kept = ["row", "text"] if keep_text else ["row"]
        return pa.Table.from_arrays([*(left.column(c) for c in kept), pa.array(hits, kind)], [*kept, "found"])

    texts_kept = [rows.schema["text"]] if keep_text else []
    schema = T.StructType([T.StructField("row", T.StructType(others)), *texts_kept, T.StructField("found", result)])
    ended = rows.groupBy("bucket").cogroup(seen.groupBy("bucket")).applyInArrow(finish, schema)
    own = {f.name: F.col("text") if f.name == text else F.col("row")[f.name] for f in df.schema.fields if keep_text or f.name != text}
    return ended.select(*[column.alias(c) for c, column in own.items()], F.col("found").alias(out))


def _alike(texts: _Texts) -> list[np.ndarray]:
    """Maps from a row to the rows equal to it in id and tie: itself first, then one more per repetition."""
    pairs = np.unique(np.stack([texts.doc, texts.tie]), axis=1, return_inverse=True)[1].reshape(-1)
    order = np.argsort(pairs, kind="stable")
    first = np.searchsorted(pairs[order], pairs)
    size = np.bincount(pairs)[pairs]
    return [order[first + np.minimum(k, size - 1)] for k in range(int(size.max(initial=1)))]


@B.any_names
def without_repeats(found: DataFrame, *, text: str = "text", repeats: str = "repeats") -> DataFrame:
    """Cut the spans out of the texts, leaving characters whole; rows of which only blanks are left go.

    A span's first character stays if only part of it is in the span. Rows without spans are
    kept as they are, null and empty texts included.
    """
    names = [c for c in found.columns if c != repeats]
    schema = T.StructType([f for f in found.schema.fields if f.name != repeats])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.slices(parts, text):
            hits = rows.column(repeats)
            sizes = pc.list_value_length(pc.struct_field(hits, "spans"))
            hit = np.asarray(pc.fill_null(sizes, 0)) > 0
            own = np.flatnonzero(hit)
            texts, keep = rows.column(text).take(pa.array(own)).to_pylist(), np.ones(len(hit), bool)
            spans_of = pc.struct_field(hits.take(pa.array(own)), "spans").to_pylist()
            for i, spans in enumerate(spans_of):
                data, pieces, at = texts[i].encode(), [], 0
                for s in spans:
                    start, end = s["start"], s["end"]
                    while start < end and data[start] & 0xC0 == 0x80:
                        start += 1
                    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
                        end -= 1
                    pieces.append(data[at:start])
                    at = end
                texts[i] = b"".join([*pieces, data[at:]]).decode()
                keep[own[i]] = bool(texts[i].strip())
            columns = {c: rows.column(c) for c in names}
            if texts:
                columns[text] = pc.replace_with_mask(columns[text], pa.array(hit), pa.array(texts, columns[text].type))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(keep))

    return found.mapInArrow(cut, schema)
