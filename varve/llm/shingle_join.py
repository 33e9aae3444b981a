"""Near copies by word shingles: a MinHash LSH forest with exact verification.

Texts are sets of runs of ``width`` words (A-Z folded, ASCII white space
separates). Documents with equal sets are one class and go through the join
once. Each class has a signature of minimum hashes, cut into labels for
``trees`` sorted prefix tries; ``varve.llm.forest`` finds how long a prefix
counts for each class in each trie, and classes whose prefix ends in the same
node meet. Meetings are verified on the whole sets, so links are exact; a pair
is verified in the first trie in which it meets.

Nodes of a trie that have the same members as one of an earlier trie are left
out. A node with many members, or with long texts, is split into blocks. A block
is packed into one row, and each pair of blocks is a task of its own that gets
these two rows, so a group of near copies that fills a third of the table is
spread out, and joins make rows in proportion to members and to pairs of
blocks, not to members times blocks. Tasks count the links of each member and
return those counts and a spanning forest, never the pairs.

A text of fewer than ``width`` words is one shingle. Texts without words
(NULL, empty, blank) are copies of each other and near to nothing else. A NULL
key is carried along; the class id is the smallest key of the group, NULL if it
has none. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import fresh, materialise, whole_text
from varve.llm.components import connected_components
from varve.llm.forest import depths_of, meetings
from varve.llm.words import WordHashes, mixed, windows, words_of
from varve.session import ship

WIDTH = 5
SIMILARITY = 0.8
TREES = 24
DEEPEST = 6
# Share of the links at exactly the threshold that must meet.
RECALL = 0.9999
# Members and shingles of a block.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
# Pairs whose signatures agree less than the threshold by this many standard errors are not links.
ERRORS = 6.0

_FACTORS = mixed(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    return np.unique(windows(hashes(words), width))


def signature(shingles: np.ndarray, values: int) -> np.ndarray:
    """The upper halves of the smallest hash under each of ``values`` multipliers."""
    least = np.full(values, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 2048):
        np.minimum(least, np.multiply.outer(_FACTORS[:values], shingles[a:a + 2048]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _columns(spec: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, as shingles take more room than texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _signed(values: int, width: int) -> Callable:
    schema = _columns("class binary, n long, signature binary")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _slices(batches):
            sets = [shingle_set(words_of(t.as_py()), hashes, width) for t in batch.column("text")]
            made = [
                pa.array([_class_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s, values).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            ]
            kept = [f for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *made], schema=pa.schema([*kept, *schema]))

    return sign


def _shingled(width: int) -> Callable:
    schema = _columns("class binary, shingles binary")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _slices(batches):
            sets = [shingle_set(words_of(t.as_py()), hashes, width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                pa.array([_class_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], schema=schema)

    return shingle


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal (node, i, j) in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "i", "j")])
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


class _Members:
    """The members of one task, with their signatures and the nodes they pass."""

    def __init__(self, table: pa.Table, trees: int, deepest: int):
        self.values = trees * deepest
        raw = b"".join(table.column("signature").to_pylist())
        self.signatures = np.frombuffer(raw, dtype=np.uint32).reshape(-1, self.values)
        self.sizes = table.column("n").to_numpy()
        self.block = table.column("block").to_numpy()
        self.tree = table.column("tree")[0].as_py()
        labels = self.signatures.reshape(-1, trees, deepest).astype(np.uint64)
        depths = table.column("depths").combine_chunks().flatten().to_numpy().reshape(-1, trees)
        nodes = np.zeros(depths.shape, dtype=np.uint64)
        for d in range(deepest):
            nodes = np.where(d < depths, mixed(nodes + labels[:, :, d] * np.uint64(2) + np.uint64(1)), nodes)
        self.nodes = nodes[:, :self.tree + 1]

    def candidates(self, i: int, j: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that meet here first and whose sizes and signatures allow a link."""
        margin = ERRORS * np.sqrt(similarity * (1 - similarity) / self.values)
        left, right = np.flatnonzero(self.block == i), np.flatnonzero(self.block == j)
        found = []
        for k, a in enumerate(left.tolist()):
            others = right[k + 1:] if i == j else right
            if not len(others):
                continue
            same = self.nodes[others] == self.nodes[a]
            others = others[same[:, -1] & ~same[:, :-1].any(axis=1)]
            small, large = np.minimum(self.sizes[others], self.sizes[a]), np.maximum(self.sizes[others], self.sizes[a])
            others = others[small >= similarity * large - 1e-9]
            agree = (self.signatures[others] == self.signatures[a]).mean(axis=1)
            others = others[agree >= similarity - margin]
            if len(others):
                found.append((np.full(len(others), a), others))
        if not found:
            return np.empty(0, int), np.empty(0, int)
        return tuple(np.concatenate(x) for x in zip(*found))


def _needed(trees: int, deepest: int, similarity: float) -> Callable:
    schema = _columns("node long, i int, j int, tree int, block int, class binary")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in _tasks(batches):
            pairs = _Members(table, trees, deepest).candidates(i, j, similarity)
            rows = np.unique(np.concatenate(pairs))
            if len(rows):
                yield from table.select(schema.names).take(pa.array(rows)).cast(schema).to_batches()

    return needed


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, i, j, tree, block, members) as a row per member."""
    for batch in batches:
        for a in range(batch.num_rows):  # a row has as many members as a task should hold of one block
            members = batch.column("members").slice(a, 1).flatten()
            shared = {c: pa.repeat(batch.column(c)[a], len(members)) for c in ("node", "i", "j", "tree", "block")}
            fields = [members.type.field(i).name for i in range(members.type.num_fields)]
            yield pa.RecordBatch.from_arrays([*shared.values(), *members.flatten()], names=[*shared, *fields])


def _bucket_marks(classes: list[bytes]) -> int:
    """64 marks for a set of classes, by their first byte, as a signed number."""
    marks = 0
    for c in classes:
        marks |= 1 << (c[0] & 63)
    return marks - (1 << 64) if marks >> 63 else marks


def _flagged(trees: int, deepest: int, similarity: float) -> Callable:
    """Which pairs of blocks have candidates, and marks of the members of either that are among these."""
    schema = _columns("node long, i int, j int, tree int, marks_i long, marks_j long")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, i, j), table in _tasks(_unpacked(batches)):
            members = _Members(table, trees, deepest)
            left, right = members.candidates(i, j, similarity)
            if len(left):
                classes = table.column("class")
                marks = [_bucket_marks(classes.take(pa.array(np.unique(x))).to_pylist()) for x in (left, right)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip((node, i, j, members.tree, *marks), schema)], schema=schema
                )

    return flag


def common_sizes(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common elements of pairs of sorted sets."""
    out = np.zeros(len(left), dtype=np.int64)
    elements, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    width = int(column[-1]) + 1 if len(column) else 0
    if len(left) < len(sets) or len(sets) * width > 1 << 29:
        for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            out[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    bits = np.zeros((len(sets), (width + 63) // 64 * 8), dtype=np.uint8)
    at = 0
    for k, s in enumerate(sets):
        mine = place[at:at + len(s)]
        at += len(s)
        row = np.zeros(bits.shape[1] * 8, dtype=bool)
        row[column[mine[counts[mine] > 1]]] = True
        bits[k] = np.packbits(row)
    words = bits.view(np.uint64)
    step = max(1, (1 << 22) // max(1, words.shape[1]))
    for a in range(0, len(left), step):
        both = words[left[a:a + step]] & words[right[a:a + step]]
        out[a:a + step] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return out


def _verified(trees: int, deepest: int, similarity: float, packed: bool = False) -> Callable:
    schema = _columns("class binary, root binary, links long")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in _tasks(_unpacked(batches) if packed else batches):
            left, right = _Members(table, trees, deepest).candidates(i, j, similarity)
            if not len(left):
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            both = common_sizes(sets, left, right)
            linked = both >= similarity * (sizes[left] + sizes[right] - both) - 1e-9
            left, right = left[linked], right[linked]
            copies = table.column("copies").to_numpy()
            links = np.zeros(len(sets), dtype=np.int64)
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
            root = np.arange(len(sets))
            while True:  # the smallest member that links lead to
                before = root.copy()
                least = np.minimum(root[left], root[right])
                np.minimum.at(root, left, least)
                np.minimum.at(root, right, least)
                root = root[root]
                if (root == before).all():
                    break
            rows = np.flatnonzero(links > 0)
            classes = table.column("class").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([classes[r] for r in rows], pa.binary()), pa.array([classes[root[r]] for r in rows], pa.binary()),
                pa.array(links[rows]),
            ], schema=schema)

    return verify


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH,
    trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL,
) -> DataFrame:
    """One row per document: key, class_id, class_size, n_links.

    ``class_id`` is the smallest key of the documents that links lead to,
    ``n_links`` the number of other documents whose similarity to this one
    reaches the threshold, copies included.
    """
    found = _near_copies(docs, key, text, similarity, width, trees, deepest, recall)
    return found.select(F.col("key").alias(key), "class_id", "class_size", "n_links")


def _text_mark(text: str) -> Column:
    """16 bytes that tell texts apart; equal texts are of one class."""
    return F.substring(F.unhex(F.sha2(whole_text(named(text)), 256)), 1, 16)


def _near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH,
    trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, marked: bool = False,
) -> DataFrame:
    """Columns key, class_id, class_size, n_links; if ``marked`` also ``mark``, which tells the row's text."""
    ship(docs.sparkSession)
    values = trees * deepest
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(named(key).alias("key"), whole_text(named(text)).alias("text"))
    mark = [_text_mark("text").alias("mark")] if marked else []
    members = materialise(rows.select("key", *mark, "text").mapInArrow(
        _signed(values, width), f"key {kind}, {'mark binary, ' if marked else ''}class binary, n long, signature binary"
    ))
    classes = materialise(members.groupBy("class").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("signature").alias("signature"),
    ))

    nodes = meetings(classes, trees, deepest, similarity, recall)
    sizes = nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("tree").alias("tree"),
        F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y"),
    ).where("members > 1")
    # Nodes with the same members as a node of an earlier trie have nothing to add.
    first = sizes.groupBy("members", "x", "y").agg(F.min(F.struct("tree", "node", "shingles")).alias("f"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("f.shingles") / BLOCK_SHINGLES)).cast("int")
    first = first.select("f.tree", "f.node", blocks.alias("blocks"))
    placed = materialise(nodes.select("class", "node").join(first, "node").withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    ))
    described = materialise(
        classes.select("class", "n", "signature", "copies").join(depths_of(nodes, trees, deepest), "class")
    )
    how = (trees, deepest, similarity)

    def by_task(df: DataFrame) -> DataFrame:
        return df.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")

    def by_block(members: DataFrame, *fields: str) -> DataFrame:
        """One row per block; blocks have members for one task."""
        return members.groupBy("node", "tree", "blocks", "block").agg(F.collect_list(F.struct(*fields)).alias("members"))

    # Nodes of one block are a task each. Of larger ones, blocks travel as one row.
    alone = placed.where("blocks = 1").select("node", F.lit(0).alias("i"), F.lit(0).alias("j"), "tree", "block", "class")
    needed = materialise(by_task(alone.join(described.drop("copies"), "class")).mapInArrow(
        _needed(*how), "node long, i int, j int, tree int, block int, class binary"
    ))
    large = placed.where("blocks > 1")
    packed = by_block(large.join(described.drop("copies"), "class"), "class", "n", "signature", "depths")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = packed.select("node", "tree", "block", "members", others).select(
        "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "tree", "block", "members"
    )
    flagged = materialise(by_task(met).mapInArrow(
        _flagged(*how), "node long, i int, j int, tree int, marks_i long, marks_j long"
    ))
    marked = flagged.select("node", F.inline(F.array(
        F.struct(F.col("i").alias("block"), F.col("marks_i").alias("marks")),
        F.struct(F.col("j").alias("block"), F.col("marks_j").alias("marks")),
    ))).groupBy("node", "block").agg(F.bit_or("marks").alias("marks"))
    mark = F.conv(F.hex(F.substring("class", 1, 1)), 16, 10).cast("int").bitwiseAND(63)
    wanted_large = materialise(large.join(marked, ["node", "block"]).where(F.getbit("marks", mark) == 1).drop("marks"))

    wanted = needed.select("class").unionByName(wanted_large.select("class")).distinct()
    wanted = wanted.join(classes.select("class", "key"), "class").select(F.col("key").alias("k")).distinct()
    texts = rows.join(wanted, F.col("key").eqNullSafe(F.col("k")), "left_semi")
    sets = texts.select("text").mapInArrow(_shingled(width), "class binary, shingles binary").dropDuplicates(["class"])
    if not wanted_large.isEmpty():
        sets = materialise(sets)  # read for both kinds of nodes
    full = needed.join(described, "class").join(sets, "class")
    spec = "class binary, root binary, links long"
    links = materialise(by_task(full).mapInArrow(_verified(*how), spec))
    if not wanted_large.isEmpty():
        blocks_of = by_block(
            wanted_large.join(described, "class").join(sets, "class"), "class", "n", "signature", "depths", "copies", "shingles"
        ).drop("tree", "blocks")
        pairs = flagged.select("node", "i", "j", "tree", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        between = by_task(pairs.join(blocks_of.hint("merge"), ["node", "block"]))
        links = links.unionByName(materialise(between.mapInArrow(_verified(*how, True), spec)))

    stars = connected_components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("class").agg(F.sum("links").alias("links"))
    linked = classes.select("class", "key", "copies").join(stars.withColumnsRenamed({"a": "class", "b": "star"}), "class", "left")
    linked = linked.join(counted, "class", "left").select(
        "class", "key", "copies", F.coalesce("star", "class").alias("star"), F.coalesce("links", F.lit(0)).alias("links")
    )
    groups = linked.groupBy("star").agg(F.min("key").alias("class_id"), F.sum("copies").alias("class_size"))
    found = linked.join(groups, "star").select(
        "class", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links")
    )
    return members.drop("n", "signature").join(found, "class").drop("class")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` of which no document with a smaller key is in the same group.

    A key that repeats with different texts loses only the rows whose own text is
    in such a group. Rows without a key cannot be told apart and stay.
    """
    found = _near_copies(docs, key, text, marked=True, **how)
    gone, gone_mark = fresh(docs, "gone", "gone_mark")
    dropped = found.where(F.col("key") != F.col("class_id")).select(F.col("key").alias(gone), F.col("mark").alias(gone_mark)).distinct()
    return docs.join(dropped, (named(key) == named(gone)) & (_text_mark(text) == named(gone_mark)), "left_anti")
