"""Near-duplicate documents by a chosen-path similarity join.

Each distinct shingle set gets a sketch of minwise values. In every tree a document's path
starts with one chosen sketch position, and a node holds the documents with equal values
along its path. Nodes of up to ``WHOLE`` documents are compared exhaustively by sketch, larger
than ``NODE`` in blocks; only what is larger still branches on further positions. Whatever
sketches call similar is put into groups of bounded size, in which links are confirmed on the
full sets.

The trees are taken in two rounds. The links of the first round give components; in the second
one, nodes within one component are dropped, and only members that look like one of another
component are confirmed.

Every table is in proportion to the documents: no node emits its pairs, a group emits a
spanning forest of its links, and equal sets are one document from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import batches as B
from flowlens.llm.components import components
from flowlens.session import broadcast_if_small, materialized

POSITIONS = 128
#: Independent trees. A pair of similarity s meets in one tree's child of the root with
#: probability s, so 8 trees miss (1 - s) ** 8 of the pairs in small nodes.
TREES = 8
#: Trees of the first round.
FIRST = 2
#: Documents compared in one task; in blocks, so many of one node; levels of branching at most.
NODE, WHOLE, LEVELS = 4_096, 65_536, 40
#: Documents, and shingles of theirs, in one part of a group; every two parts are confirmed together.
PART, PART_SHINGLES = 2_048, 1_000_000
#: Groups of more documents are confirmed by rows of bits, so many columns at a time.
FEW, COLUMNS = 24, 1 << 14
#: Up to so many ids of candidates are broadcast to pick their texts.
ASKED = 100_000
_SEEDS = B.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64))
_FACTORS = B.mix(np.arange(1001, POSITIONS + 1001, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted 64-bit prints of the distinct shingles of each text.

    Words are runs without ASCII white space, A-Z as a-z. A text of fewer words, but not
    none, has its whole sequence as its only shingle; null and empty texts have none.
    """
    data, at = B.text_bytes(texts)
    start, end, row = B.runs(data, at, B.SOLID_BYTES)
    prints = B.mix(B.Fingerprints(data, B.LOWER).spans(start, end))
    bounds = B.per_row(row, len(texts))
    factor = np.uint64(0x9E3779B97F4A7C15)
    rolled = prints.copy()
    for k in range(1, words):
        rolled = B.mix(rolled * factor)
        rolled[: len(prints) - k] += prints[k:]
    rolled = B.mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            found = np.sort(rolled[a : b - words + 1])
            out.append(found[np.r_[True, found[1:] != found[:-1]]])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for p in prints[a:b]:
                whole = B.mix(whole * factor + p)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketches(sets: list[np.ndarray], trees: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set that isn't empty: 16-bit minwise values, and the root's child in every tree.

    A tree's root chose one position. Its children are told apart by the whole 64-bit
    value, so documents that share none don't meet there however many there are.
    """
    full = [s for s in sets if len(s)]
    out = np.empty((len(full), POSITIONS), np.uint16)
    roots = np.empty((len(full), trees), np.uint64)
    if full:
        prints = np.concatenate(full)
        at = np.r_[0, np.cumsum([len(s) for s in full])[:-1]]
        for i in range(POSITIONS):
            lowest = B.mix(np.minimum.reduceat((prints ^ _SEEDS[i]) * _FACTORS[i], at))
            out[:, i] = lowest >> np.uint64(48)
            if i < trees:
                roots[:, i] = B.mix(lowest + np.uint64(i))
    return out, roots


def signatures(documents: DataFrame, *, key: str, text: str, words: int, trees: int = TREES) -> DataFrame:
    """id, n_shingles, two prints of the whole set, and the sketch and root children (null for an empty set)."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.slices(parts, "text"):
            sets = shingle_sets(rows.column("text"), words)
            sums = [int(s.sum(dtype=np.uint64)) for s in sets]
            folds = [int(np.bitwise_xor.reduce(B.mix(s))) if len(s) else 0 for s in sets]
            sketch, roots = _sketches(sets, trees)
            full = np.array([len(s) > 0 for s in sets])
            place = pa.array(np.cumsum(full) - 1, mask=~full)
            raw = pa.array([r.tobytes() for r in sketch], pa.binary()).take(place)
            nodes = B.list_array(pa.array(roots.reshape(-1).view(np.int64)), np.arange(len(roots) + 1) * trees).take(place)
            yield pa.RecordBatch.from_arrays(
                [rows.column("key").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(np.array(sums, np.uint64).view(np.int64)), pa.array(np.array(folds, np.uint64).view(np.int64)), raw, nodes],
                ["id", "n_shingles", "sum", "fold", "sketch", "roots"],
            )

    kinds = "id long, n_shingles long, sum long, fold long, sketch binary, roots array<long>"
    rows = documents.select(B.name(key).alias("key"), B.name(text).alias("text"))
    return rows.mapInArrow(sign, kinds)


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _child(node: np.ndarray, sketch: np.ndarray, branch: int) -> np.ndarray:
    """The child node of each row: its parent, a position the parent chose, the value there."""
    position = (B.mix(node + np.uint64(7919 * (branch + 1))) % np.uint64(POSITIONS)).astype(np.int64)
    value = sketch[np.arange(len(node)), position].astype(np.uint64)
    return B.mix(node ^ B.mix(value << np.uint64(16) | position.astype(np.uint64)))


def keyed(parts: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key as one table; rows must come sorted by key."""
    held: list[pa.RecordBatch] = []
    for rows in parts:
        if not rows.num_rows:
            continue
        values = rows.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), rows.num_rows]
        if held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, rows.slice(a, b - a)])
            held = []
        held.append(rows.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def _merged(root: np.ndarray, i: int, others: np.ndarray) -> list[int]:
    """Joins i's tree with those of ``others``; of each tree that was another one, one member."""
    trees, first = np.unique(root[others], return_index=True)
    new = trees != root[i]
    if new.any():
        root[np.isin(root, np.r_[trees, root[i]])] = min(trees.min(), root[i])
    return others[first[new]].tolist()


def _alike(sketch: np.ndarray, label: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Trees of what sketches call alike, and which rows are alike to one of another label."""
    n = len(sketch)
    floor = similarity - 4 * math.sqrt(similarity * (1 - similarity) / POSITIONS)
    # one bit of each value tells most pairs apart that have little in common
    bits = np.packbits((sketch & 1).astype(bool), axis=1).view(np.uint64)
    agree = (1 + similarity) / 2
    apart = POSITIONS * (1 - agree) + 6 * math.sqrt(POSITIONS * agree * (1 - agree))
    root, mixed = np.arange(n), np.zeros(n, bool)
    for i in range(n - 1):
        some = i + 1 + np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1, dtype=np.int64) <= apart)
        some = some[np.count_nonzero(sketch[some] == sketch[i], axis=1) >= floor * POSITIONS]
        if len(some):
            _merged(root, i, some)
            other = some[label[some] != label[i]]
            mixed[other] = True
            mixed[i] |= len(other) > 0
    return root, mixed


def _parts(sizes: np.ndarray) -> np.ndarray:
    """The part of each row: at most ``PART`` rows and about ``PART_SHINGLES`` shingles in one."""
    return np.arange(len(sizes)) // PART + (np.cumsum(sizes) - sizes) // PART_SHINGLES


def _groups_of(cells: DataFrame, similarity: float) -> DataFrame:
    """Groups (group, id) of documents that sketches link within a cell, if of different labels."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, members = [], []
        for cell in keyed(parts, "cell"):
            if cell.num_rows < 2:
                continue
            ids, label, sizes = (cell.column(c).to_numpy() for c in ("id", "label", "n_shingles"))
            root, mixed = _alike(_sketch_rows(cell.column("sketch")), label, similarity)
            for tree in np.unique(root[mixed]):
                own = np.flatnonzero(mixed & (root == tree))
                own = own[np.argsort(ids[own])]
                part = _parts(sizes[own])
                blocks = np.unique(part).tolist()
                for i in blocks:
                    for j in blocks[blocks.index(i) + (len(blocks) > 1) :]:
                        some = ids[own[(part == i) | (part == j)]]
                        # equal groups of several trees have one name
                        name = B.mix(some.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                        groups.append(np.full(len(some), name))
                        members.append(some)
            if len(members) > 5_000:
                yield _groups(groups, members)
                groups, members = [], []
        if members:
            yield _groups(groups, members)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "group long, id long")


def _groups(groups: list[np.ndarray], members: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(groups).astype(np.uint64).view(np.int64)), pa.array(np.concatenate(members))], ["group", "id"]
    )


def _below(stay: np.ndarray, node: np.ndarray, sketch: np.ndarray, similarity: float) -> tuple[pa.Array, pa.Array]:
    """Rows that stay, some of them twice, and their child nodes."""
    forked = stay[B.mix(node[stay] ^ np.uint64(0xA5A5A5A5)) < np.uint64(int((1 / similarity - 1) * 2**64))]
    below = np.r_[_child(node[stay], sketch[stay], 0), _child(node[forked], sketch[forked], 1)].view(np.int64)
    return pa.array(np.r_[stay, forked]), pa.array(below)


def candidate_groups(signed: DataFrame, found: DataFrame | None, *, similarity: float, trees: tuple[int, int]) -> DataFrame:
    """(group, id): groups of bounded size that hold what is similar by sketch and not yet in one component.

    ``signed`` has id, n_shingles, sketch and roots, one row per distinct set; ``found`` id and
    component of those in links. Of a tree's nodes of up to ``WHOLE`` members nothing is left
    out; in larger ones documents of the wanted similarity go on meeting in one child on average.
    """
    named = signed.select("id", "roots")
    named = named.withColumn("label", F.col("id")) if found is None else named.join(found, "id", "left").withColumn("label", F.coalesce("component", "id"))
    nodes = F.slice("roots", trees[0] + 1, trees[1] - trees[0])
    active = named.select("id", "label", F.explode(nodes).alias("node"))
    more = []
    for level in range(LEVELS + 1):
        sizes = active.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        active = materialized(active.join(sizes.where("low <> high").select("node", "n"), "node"), "near-nodes")
        last = level == LEVELS
        blocks = F.when(F.col("n") <= NODE, 1).otherwise(F.ceil(2 * F.col("n") / NODE)).cast("int")
        whole = active if last else active.where(F.col("n") <= WHOLE)
        dealt = whole.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "node"), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cell = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
        cells = dealt.select(cell.alias("cell"), "id", "label").join(signed.select("id", "n_shingles", "sketch"), "id")
        more.append(materialized(_groups_of(cells, similarity), "near-groups"))
        large = active.where(F.col("n") > WHOLE)
        if last or not large.limit(1).count():
            break
        active = _branched(large.join(signed.select("id", "sketch"), "id"), similarity)
    groups = more[0]
    for other in more[1:]:
        groups = groups.unionByName(other)
    return groups.distinct()


def _branched(rows: DataFrame, similarity: float) -> DataFrame:
    """Members of nodes in the children they go on in: one, or two with a chance of 1 / similarity - 1."""

    def branch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            node = batch.column("node").to_numpy().view(np.uint64)
            own, below = _below(np.arange(batch.num_rows), node, _sketch_rows(batch.column("sketch")), similarity)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("label").take(own), below], ["id", "label", "node"])

    return rows.mapInArrow(branch, "id long, label long, node long")


def _links_of_few(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int, int, int]]:
    """A forest of the links between a few sets: two places, common and whole."""
    root = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if root[i] == root[j] or 100 * small < percent * large or not small:
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            whole = len(both) - common
            if 100 * common >= percent * whole:
                _merged(root, i, np.array([j]))
                yield i, j, common, whole


def _links_of_many(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int, int, int]]:
    """The same for many sets, by rows of bits for the shingles that several of them have."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    owner, shingle = owner[shared[shingle]], (np.cumsum(shared) - 1)[shingle[shared[shingle]]]
    width = int(shared.sum())
    rows = []
    for start in range(0, max(width, 1), COLUMNS):
        inside = (shingle >= start) & (shingle < start + COLUMNS)
        dense = np.zeros((n, -(-min(COLUMNS, max(width - start, 1)) // 64) * 64), bool)
        dense[owner[inside], shingle[inside] - start] = True
        rows.append(np.packbits(dense, axis=1).view(np.uint64))
    bits = np.concatenate(rows, axis=1)
    root = np.arange(n)
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[(100 * low >= percent * high) & (low > 0)]
        common = np.zeros(len(rest), np.int64)
        for at in range(0, len(rest), 256):
            common[at : at + 256] = np.bitwise_count(bits[rest[at : at + 256]] & bits[i]).sum(axis=1, dtype=np.int64)
        whole = sizes[rest] + sizes[i] - common
        near = 100 * common >= percent * whole
        if near.any():
            seen = {int(j): (int(c), int(w)) for j, c, w in zip(rest[near], common[near], whole[near], strict=True)}
            for j in _merged(root, i, rest[near]):
                yield i, j, *seen[j]


def confirmed_links(groups: DataFrame, documents: DataFrame, *, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Links (a, b, common, whole) that connect the members of each group as far as their full sets allow."""
    asked = broadcast_if_small(groups.select("id").distinct(), ASKED)
    texts = documents.select(B.name(key).cast("long").alias("id"), B.name(text).alias("text")).join(asked, "id", "left_semi")
    rows = groups.join(texts, "id").select("group", "id", "text").repartition("group").sortWithinPartitions("group", "id")

    def confirm(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in keyed(B.slices(parts, "text"), "group"):
            ids = group.column("id").to_pylist()
            sets = [s for c in group.column("text").chunks for s in shingle_sets(c, words)]
            found = list((_links_of_few if len(ids) <= FEW else _links_of_many)(sets, percent))
            links = [(ids[i], ids[j], common, whole) for i, j, common, whole in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in range(4)], ["a", "b", "common", "whole"]
            )

    return rows.mapInArrow(confirm, "a long, b long, common long, whole long")


def near_duplicates(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, trees: int = TREES
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links), kept.

    Two rows are linked if 100 * intersection >= percent * union of their shingle sets. An
    empty set is linked with nothing. Rows of one id count as one document; a row without an
    id is linked with nothing, has no component and is kept. Other columns play no part.
    """
    signed = materialized(signatures(documents, key=key, text=text, words=words, trees=trees), "near-signatures")
    full = signed.where("id is not null and n_shingles > 0")
    same = ["n_shingles", "sum", "fold"]
    first = full.groupBy(*same).agg(F.min("id").alias("rep"))
    member = materialized(full.select("id", *same).join(first, same).select("id", "rep"), "near-members")
    sketches = materialized(
        full.select("id", "n_shingles", "sketch", "roots").join(first.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]),
        "near-sketches",
    )
    # rows of one id but different sets belong together too
    again = member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    links, found = again.select(F.col("low").alias("a"), F.col("high").alias("b")), None
    for part in ((0, min(FIRST, trees)), (min(FIRST, trees), trees)):
        groups = materialized(candidate_groups(sketches, found, similarity=percent / 100, trees=part), "near-candidates")
        more = confirmed_links(groups, documents, key=key, text=text, words=words, percent=percent)
        links = materialized(links.unionByName(more.select("a", "b")), "near-links")
        found = components(links)
    found = found.withColumnRenamed("id", "rep")
    component = member.join(found, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    rows = signed.select("id", "n_shingles").join(component, "id", "left")
    rows = rows.withColumn("component_id", F.coalesce("component_id", "id"))
    return rows.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
