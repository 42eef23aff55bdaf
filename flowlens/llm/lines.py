"""Lines that many documents share, kept in one document only.

The 128-bit prints of long lines are range-partitioned with the document, and sorted by print,
document and place. A task then streams its lines in that order: the first document of a print
(the one of largest id) keeps the line, and once enough documents are seen all others lose it,
so a task holds a few documents' lines and never a whole group. Ranges may cut through a print;
each task tells how many documents its first and its last print had, and those few sums settle
the rest. What comes back per document is a compressed bitmap of the lines it keeps, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import batches as B
from flowlens.session import broadcast_if_small, materialized

#: Keys have at least so many code points, and so many documents, to lose their lines.
POINTS, DOCUMENTS = 40, 5
#: Sums of cut prints, at most two a task, that are broadcast.
CUT_PRINTS = 1_000_000
#: Fixed value: what is stripped at both ends of a line.
_BLANK = b" \t\n\v\f\r"
_LOWER = bytes(B.LOWER)
#: What a streamed row is: a line to drop, a line of a cut print, the sums of a cut print.
_DROP, _OPEN, _SUM = 0, 1, 2
_STREAMED = "kind int, high long, low long, doc long, version long, place int, docs long"


def _printed(documents: DataFrame, key: str, text: str, points: int) -> DataFrame:
    """high, low, doc, version, place of every line whose key is long enough."""
    rows = documents.where(B.name(key).isNotNull() & B.name(text).isNotNull()).select(
        B.name(key).cast("long").alias("doc"), F.xxhash64(B.name(text)).alias("version"), B.name(text).cast("binary").alias("text")
    )

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(parts, "text"):
            prints, owner, places = [], [], []
            for row, whole in enumerate(batch.column("text").to_pylist()):
                for place, line in enumerate(whole.translate(_LOWER).split(b"\n")):
                    line = line.strip(_BLANK) if len(line) >= points else b""
                    if len(line) >= points and (line.isascii() or len(line.decode(errors="replace")) >= points):
                        prints.append(blake2b(line, digest_size=16).digest())
                        owner.append(row)
                        places.append(place)
            both = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            own = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column("doc").take(own), batch.column("version").take(own),
                 pa.array(places, pa.int32())],
                ["high", "low", "doc", "version", "place"],
            )

    return rows.mapInArrow(split, "high long, low long, doc long, version long, place int")


class _Stream:
    """Lines in order of print, document (largest first) and place, read batch by batch."""

    def __init__(self, documents: int):
        self.documents = documents
        self.first = True  # still in the task's first print, which may have begun in another task
        self.print: tuple[int, int] | None = None
        self.docs, self.top, self.last = 0, 0, 0  # of the print at hand: documents, the largest, the latest
        self.held: list[pa.RecordBatch] = []  # its lines while too few documents are seen

    def _rows(self, kind: int, lines: pa.RecordBatch) -> pa.RecordBatch:
        n = lines.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *lines.columns, pa.nulls(n, pa.int64())],
            ["kind", "high", "low", "doc", "version", "place", "docs"],
        )

    def _sum(self) -> pa.RecordBatch:
        high, low = self.print
        values = [[_SUM], [high], [low], [self.top], [None], [None], [self.docs]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["kind", "high", "low", "doc", "version", "place", "docs"]
        )

    def _ended(self, at_end: bool) -> Iterator[pa.RecordBatch]:
        """The print at hand has no more lines in this task."""
        if self.print is None:
            return
        if at_end:
            for lines in self.held:
                yield self._rows(_OPEN, lines)
        if self.first or at_end:
            yield self._sum()
        self.held, self.first = [], False

    def _taken(self, lines: pa.RecordBatch, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lines of the print at hand, its first ones or more of them."""
        new = np.r_[not self.docs or doc[0] != self.last, doc[1:] != doc[:-1]]
        if not self.docs:
            self.top = int(doc[0])
        self.docs += int(new.sum())
        self.last = int(doc[-1])
        if self.first:
            yield self._rows(_OPEN, lines)
        elif self.docs < self.documents:
            self.held.append(lines)
        else:
            for old in [*self.held, lines]:
                others = old.filter(pa.array(old.column("doc").to_numpy() != self.top))
                if others.num_rows:
                    yield self._rows(_DROP, others)
            self.held = []

    def read(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            high, low, doc = (batch.column(c).to_numpy() for c in ("high", "low", "doc"))
            starts = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            ends = np.r_[starts[1:], len(high)]
            # Prints of fewer lines than documents asked for need no look, unless at an edge.
            look = ends - starts >= self.documents
            look[[0, -1]] = True
            for a, b in zip(starts[look].tolist(), ends[look].tolist(), strict=True):
                name = (int(high[a]), int(low[a]))
                if name != self.print:
                    yield from self._ended(False)
                    self.print, self.docs = name, 0
                yield from self._taken(batch.slice(a, b - a), doc[a:b])
        yield from self._ended(True)


def dropped_lines(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", points: int = POINTS, least: int = DOCUMENTS
) -> DataFrame:
    """doc, version, keep: a bitmap for each document that loses lines.

    A line's key is the line without ASCII white space at both ends, A-Z as a-z. Keys of at least
    ``points`` code points in at least ``least`` documents lose all lines but those of the
    largest id. ``keep`` is the zlib-compressed bits, one a line up to the last that goes. Rows
    of one id count as one document, and ``version`` (a print of the text) tells its
    different texts apart; rows without an id or a text have no lines that count.
    """
    printed = materialized(_printed(documents, key, text, points), "lines-printed")
    order = ["high", "low", F.desc("doc")]
    dealt = printed.repartitionByRange(*order).sortWithinPartitions(*order, "version", "place")
    streamed = materialized(dealt.mapInArrow(lambda parts: _Stream(least).read(parts), _STREAMED), "lines-streamed")
    totals = streamed.where(F.col("kind") == _SUM).groupBy("high", "low")
    totals = totals.agg(F.sum("docs").alias("all_docs"), F.max("doc").alias("top")).where(F.col("all_docs") >= least)
    cut = streamed.where(F.col("kind") == _OPEN).join(broadcast_if_small(totals, CUT_PRINTS), ["high", "low"])
    lines = cut.where(F.col("doc") != F.col("top")).select("doc", "version", "place")
    lines = lines.union(streamed.where(F.col("kind") == _DROP).select("doc", "version", "place"))

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            maps = []
            for places in batch.column("places").to_pylist():
                keep = np.ones(max(places) // 8 * 8 + 8, bool)  # whole bytes: what is left of the last one is kept
                keep[places] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("version"), pa.array(maps, pa.binary())], ["doc", "version", "keep"])

    places = lines.groupBy("doc", "version").agg(F.collect_set("place").alias("places"))
    return places.mapInArrow(pack, "doc long, version long, keep binary")


def _kept(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    out = []
    for whole, bits in zip(text, keep, strict=True):
        lines = [b""] if whole is None else bytes(whole).split(b"\n")
        left = lines
        if bits is not None:
            flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: len(lines)]
            gone = set(np.flatnonzero(flags == 0).tolist())
            left = [x for i, x in enumerate(lines) if i not in gone]
        out.append((None if whole is None else b"\n".join(left), len(lines), len(lines) - len(left)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def without_lines(documents: DataFrame, dropped: DataFrame, *, key: str = "doc_id", text: str = "text", into: str = "lines") -> DataFrame:
    """All rows and columns, the text without its dropped lines, and ``into``: n_lines (before), n_dropped.

    A null text stays null and counts as one empty line. A column that is called ``into``
    already is replaced. An empty table gives an empty one.
    """
    names = [c for c in documents.columns if c != into]
    rows = documents.select(
        *[B.name(c).alias(f"c{i}") for i, c in enumerate(names)],
        B.name(key).cast("long").alias("doc"), F.xxhash64(B.name(text)).alias("version"),
    )
    body = f"c{names.index(text)}"
    kept = F.pandas_udf(_kept, "text binary, n_lines long, n_dropped long")
    rows = rows.join(dropped, ["doc", "version"], "left").withColumn("made", kept(F.col(body).cast("binary"), F.col("keep")))
    kind = documents.schema[text].dataType
    return rows.select(
        *[(F.col("made.text").cast(kind) if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)],
        F.struct("made.n_lines", "made.n_dropped").alias(into),
    )
