"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints within 3 bits agree in one of four blocks of 16 bits. Distinct fingerprints are indexed in
four rotations, each with another block in front: sorted by Gray rank, in which neighbours differ in few bits, and cut
into leaves of LEAF fingerprints. The bits that all fingerprints of a leaf share are factored out
into its pattern (mask, value); FAN patterns in order are factored again, up to one root. Two
nodes can hold such fingerprints only if their patterns don't differ in the leading block, and in no more than `distance` bits at all,
where both masks are set, so pairs of nodes are followed down level by level and whole pairs of
groups are pruned by the differences they have accumulated. The levels are tables and a step down
is a join on node numbers; only the pairs of leaves that are left are compared, in numpy, and each
gives a spanning forest of its links, never all pairs. Components of the links follow by star operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sparkloom.llm.common import checkpointed, keep_rows, read
from sparkloom.llm.components import components
from sparkloom.operators.graph import numbered

DISTANCE = 3
SHINGLE = 3
LEAF = 256
FAN = 8
#: Bits of a block: fingerprints within 64 / BLOCK_BITS - 1 bits agree in a block, which leads in one of the rotations.
BLOCK_BITS = 16
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set if it is in over half the hashes of the text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([digest(x, seed) for x in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the Gray code (the inverse of i ^ i >> 1)."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def rotated(fp: np.ndarray, turn: int) -> np.ndarray:
    """Each pattern with its 64 bits turned left by turn blocks of BLOCK_BITS bits."""
    shift = np.uint64(turn * BLOCK_BITS)
    return fp << shift | fp >> (np.uint64(64) - shift) if turn else fp.copy()


def _ranked(distinct: DataFrame, turns: int) -> DataFrame:
    """Each fingerprint in every rotation: turn, fp, and rank, the Gray rank as a signed long in the order of unsigned ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for turn in range(turns):
                new = rotated(fp, turn)
                rank = gray_rank(new) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), turn, np.int32)), pa.array(new.view(np.int64)), pa.array(rank.view(np.int64))], names=["turn", "fp", "rank"])

    return distinct.mapInArrow(run, "turn int, fp long, rank long")


def pattern(fps: np.ndarray) -> tuple[int, int]:
    """(mask, value) of the bits that all the fingerprints share."""
    shared = ~(np.bitwise_and.reduce(fps) ^ np.bitwise_or.reduce(fps))
    return int(shared.view(np.int64)), int((shared & fps[0]).view(np.int64))


def _leaves(size: int):
    """Cuts one partition's fingerprints, in Gray order, into leaves of one rotation: turn, first_rank, mask, value, fps."""

    def leaf(turn: int, fps: np.ndarray, rank: int) -> pa.RecordBatch:
        mask, value = pattern(fps)
        return pa.RecordBatch.from_pydict({"turn": pa.array([turn], pa.int32()), "first_rank": [rank], "mask": [mask], "value": [value], "fps": [fps.tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, ranks = 0, np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            turn, fp, rank = (batch.column(x).to_numpy() for x in ("turn", "fp", "rank"))
            for number in np.unique(turn).tolist():
                if number != now and len(rest):
                    yield leaf(now, rest, int(ranks[0]))
                    rest, ranks = rest[:0], ranks[:0]
                now, of = number, turn == number
                rest, ranks = np.concatenate([rest, fp[of].view(np.uint64)]), np.concatenate([ranks, rank[of]])
                while len(rest) >= size:
                    yield leaf(now, rest[:size], int(ranks[0]))
                    rest, ranks = rest[size:], ranks[size:]
        if len(rest):
            yield leaf(now, rest, int(ranks[0]))

    return run


def build_levels(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The index from its leaves up: tables (node, turn, mask, value, parent), the last with one root or none. A node over
    leaves of two rotations has turn null and the bits that all of them share."""
    level = leaves.select("node", "turn", "mask", "value")
    levels = []
    while True:
        level = checkpointed(level.withColumn("parent", F.floor(F.col("node") / fan)))
        levels.append(level)
        if level.count() <= 1:
            return levels
        ones = F.bit_and(F.col("mask").bitwiseAND(F.col("value")))
        zeros = F.bit_and(F.col("mask").bitwiseAND(F.bitwise_not("value")))
        turn = F.when(F.count("turn") == F.count("*"), F.when(F.min("turn") == F.max("turn"), F.min("turn")))
        level = level.groupBy("parent").agg(ones.alias("ones"), zeros.alias("zeros"), turn.alias("turn"))
        level = level.selectExpr("parent AS node", "turn", "ones | zeros AS mask", "ones AS value")


def close_leaves(levels: list[DataFrame], distance: int) -> DataFrame:
    """Pairs (a, b) of leaves, a <= b, of one rotation whose patterns can hold fingerprints within `distance` bits that agree in the leading block."""
    pairs = levels[-1].selectExpr("node AS a", "node AS b")
    leading = -1 << (64 - BLOCK_BITS)
    for level in levels[-2::-1]:
        left = level.selectExpr("parent AS a", "node AS a2", "turn AS turn_a", "mask AS mask_a", "value AS value_a")
        right = level.selectExpr("parent AS b", "node AS b2", "turn AS turn_b", "mask AS mask_b", "value AS value_b")
        differ = "(value_a ^ value_b) & mask_a & mask_b"
        near = f"a2 <= b2 AND coalesce(turn_a = turn_b, true) AND ({differ} & {leading}L) = 0 AND bit_count({differ}) <= {distance}"
        pairs = pairs.join(left, "a").join(right, "b").where(near).selectExpr("a2 AS a", "b2 AS b")
    return pairs


def forest(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (by value) that connect all fingerprints of two leaves which are linked within `distance` bits."""
    near_a, near_b = [], []
    for at in range(0, len(left), 64):
        a, b = np.nonzero(np.bitwise_count(left[at : at + 64, None] ^ right[None, :]) <= distance)
        near_a.append(left[a + at])
        near_b.append(right[b])
    a, b = np.concatenate(near_a), np.concatenate(near_b)
    different = a != b
    a, b = a[different], b[different]
    if len(a) <= 1:
        return list(zip(a.tolist(), b.tolist(), strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:  # least label along the links until none changes
        was = label.copy()
        least = np.minimum(label[ends[0]], label[ends[1]])
        np.minimum.at(label, ends[0], least)
        np.minimum.at(label, ends[1], least)
        label = label[label]
        if (label == was).all():
            break
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[linked].tolist(), nodes[label[linked]].tolist(), strict=True))


def links(distinct: DataFrame, distance: int = DISTANCE, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Links (u, v) among distinct fingerprints (fp) that connect all those within `distance` (less than 64 / BLOCK_BITS) bits of each other."""
    turns = 64 // BLOCK_BITS
    if not 0 <= distance < turns:
        raise ValueError("the distance must be less than the number of blocks")
    order = ["turn", "rank"]
    ordered = _ranked(distinct, turns).repartitionByRange(*order).sortWithinPartitions(*order)
    leaves = checkpointed(ordered.mapInArrow(_leaves(leaf), "turn int, first_rank long, mask long, value long, fps binary"))
    leaves = checkpointed(numbered(leaves, "turn", "first_rank").withColumnRenamed("place", "node"))
    pairs = checkpointed(close_leaves(build_levels(leaves, fan), distance))
    fps = leaves.select("node", "turn", "fps")
    alone = fps.join(pairs.where("a = b").select(F.col("a").alias("node")), "node", "left_semi").select("turn", F.col("fps").alias("left"), F.lit(None).cast("binary").alias("right"))
    met = pairs.where("a < b").join(fps.selectExpr("node AS a", "turn", "fps AS left"), "a").join(fps.selectExpr("node AS b", "fps AS right"), "b")
    met = alone.unionByName(met.select("turn", "left", "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty((0, 2), np.uint64)]
            for turn, a, b in zip(batch.column("turn").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                left = np.frombuffer(a.as_py(), np.uint64)
                right = np.frombuffer(b.as_py(), np.uint64) if b.is_valid else left
                found = np.array(forest(left, right, distance), np.uint64).reshape(-1, 2)
                out.append(rotated(found, turns - turn) if turn else found)
            both = np.concatenate(out).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["u", "v"])

    return met.mapInArrow(run, "u long, v long").distinct()


def classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fp, component_id, class_size and first_fp, the least fingerprint of component_id's rows in the class."""
    rows = checkpointed(fingerprints(docs))
    named = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    distinct = checkpointed(rows.groupBy("fp").agg(named.alias("first"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), distance)).selectExpr("node AS fp", "root")
    members = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = members.groupBy("root").agg(F.min(F.struct("first.no_id", "first.doc_id", "fp")).alias("least"), F.sum("n").alias("class_size"))
    of = checkpointed(members.join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), "class_size", F.col("least.fp").alias("first_fp")))
    return rows.join(of, "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Groups documents whose SimHash fingerprints are linked by steps of at most `distance` bits.

    docs: doc_id, text; other columns are ignored. Returns one row per input row: doc_id, fingerprint
    (16 lowercase hex digits), component_id (the smallest doc_id reachable, its own included), class_size.
    Null and empty texts have fingerprint zero and are linked like any other; equal texts are always together;
    a null doc_id never names a component unless all of its rows have none. Rows that repeat a doc_id
    stay rows of their own; a long text is read whole by one task. An empty table gives no rows.
    """
    return classes(docs, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


@F.pandas_udf(LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], np.uint64).view(np.int64))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates one row, with all its columns, whatever their names.

    It is the row whose doc_id names the group; of rows that repeat that doc_id in the group, the one of least fingerprint, then least text. A group of
    rows without a doc_id keeps one of them. Null texts are a group with the empty ones; long texts are read whole; an empty table stays empty.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("first_fp"))
    return keep_rows(docs, classes(docs).select("doc_id", F.col("fp").alias("mark"), stays.alias("stays")), _fingerprints)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
