"""MinHash near-deduplication with an LSH forest.

A text's set of shingles gives a signature of COORDINATES minima. The forest has ORDERS
trees; tree k orders the signatures by their coordinates rotated by MIN_DEPTH * k, so that
the trees' first MIN_DEPTH coordinates are independent. Each tree is one global sort, a
range-partitioned table of (tree, rotated signature): the neighbours of a text are those
with the longest common prefix. A region is a run of signatures that share at least
MIN_DEPTH coordinates; in a thin region all its texts are compared, in a crowded one the
depth adapts, as the WINDOW nearest by prefix are first. Texts in regions of their own never enter
the sort.

Candidates are confirmed on the full sets. They come in three passes. The first takes each
text's best neighbour in each of FIRST_ORDERS trees, which is enough to join most of a group at a cost that
grows with the texts, not the pairs. The second takes, in thin regions, every remaining candidate
whose ends are still in different components. The third is for crowded regions, of over WINDOW
texts, that hold several components even then: it compares all their texts across components, whatever lies between them in the
sort, block by block, so that WINDOW bounds no text's partners, and confirms them there.

Rows with equal sets are linked through the smallest doc_id of their set before any of that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import broadcast_if_small, discard, merged_if_large, staged, table
from plyforge.llm.components import EDGE_BYTES, connected_components
from plyforge.llm.shingles import mix, shingle_sets

ORDERS = 24
MIN_DEPTH = 3
COORDINATES = ORDERS * MIN_DEPTH
#: Trees of the first pass, which joins most groups; the second pass has all trees.
FIRST_ORDERS = 8
WINDOW = 64
#: Shingles of a crowded region's texts that a task holds, twice at most, or those of one text.
BLOCK = 1 << 20
#: One-bit minima that screen candidates, for the texts of the forest only.
SKETCH_BITS = 1024
#: Standard errors below the wanted similarity down to which a pair is a candidate: 4 in 10,000,000 fall short.
SLACK = 5.0
PERCENT = 75
#: Texts whose sets a task holds at once.
TEXTS = 128
#: Bytes of a row in a broadcast table, of those that are counted before a join.
ID_BYTES, PAIR_BYTES, HEAD_BYTES, CLASS_BYTES, LIVE_BYTES, ROW_BYTES = 100, 100, 50, 120, 1000, 500

_COORD_BYTES = 2
_SIGNATURE = COORDINATES * _COORD_BYTES
_HEAD = MIN_DEPTH * _COORD_BYTES
_RNG = np.random.default_rng(29)
_MULTIPLY = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_BIT_MULTIPLY = _RNG.integers(1, 1 << 63, SKETCH_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT_ADD = _RNG.integers(0, 1 << 63, SKETCH_BITS, dtype=np.uint64)
_SETS_AT_ONCE = 1 << 18  # hashes


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set its coordinates: 16 bits of the minimum under each hash function."""
    out = np.empty((len(sets), COORDINATES), dtype=">u2")
    done = 0
    while done < len(sets):
        end, size = done, 0
        while end < len(sets) and (end == done or size + len(sets[end]) <= _SETS_AT_ONCE):
            size += len(sets[end])
            end += 1
        joined = np.concatenate(sets[done:end])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[done : end - 1]], dtype=np.int64)))
        for j in range(COORDINATES):
            least = np.minimum.reduceat(joined * _MULTIPLY[j] + _ADD[j], starts.astype(np.int64))
            out[done:end, j] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
        done = end
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """A bit of the minimum under each of SKETCH_BITS hash functions; two sketches agree in about (1 + J) / 2 of them."""
    least = np.full(SKETCH_BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = 64
    for i in range(0, len(hashes), 512):
        part = hashes[i : i + 512, None]
        for j in range(0, SKETCH_BITS, step):
            own = (part * _BIT_MULTIPLY[j : j + step] + _BIT_ADD[j : j + step]).min(axis=0)
            np.minimum(least[j : j + step], own, out=least[j : j + step])
    return np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).tobytes()


def _few_or_merged(df: DataFrame, row_bytes: int) -> DataFrame:
    """df for a join that broadcasts it if its rows are few, and nothing otherwise."""
    rows = df.count()
    return merged_if_large(broadcast_if_small(df, rows, row_bytes), rows, row_bytes)


def _of_sets(documents: DataFrame, ids: DataFrame, name: str, value: Callable[[np.ndarray], bytes]) -> DataFrame:
    """doc_id and a value of the set of each document whose doc_id is among ids (_id)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                found = [value(s) for s in shingle_sets(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", name])

    chosen = documents.select("doc_id", "text").join(_few_or_merged(ids, ID_BYTES), F.col("doc_id") == F.col("_id"), "left_semi")
    return chosen.mapInArrow(made, f"doc_id long, {name} binary").dropDuplicates(["doc_id"])


def features(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets) and signature; null where the set is empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                sets = shingle_sets(part.column("text").to_pylist())
                full = [s for s in sets if len(s)]
                signed = iter(signatures(full))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "signature"],
                )

    return documents.select("doc_id", "text").mapInArrow(
        made, "doc_id long, n_shingles long, set_key binary, signature binary"
    )


def _forest(signed: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (tree, rotated, crowded, doc_id, n_shingles, sketch) of each tree, without regions of one text.

    crowded: the text's region in the tree has over WINDOW texts.
    """
    trees = F.sequence(F.lit(0), F.lit(ORDERS - 1))
    heads = signed.select("doc_id", F.explode(trees).alias("tree"), "signature").select(
        "doc_id", "tree", F.xxhash64("tree", F.substring("signature", F.col("tree") * _HEAD + 1, F.lit(_HEAD))).alias("head")
    )
    shared = heads.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head", (F.col("n") > WINDOW).alias("crowded"))
    shared = merged_if_large(shared, ORDERS * signed.count(), HEAD_BYTES)
    live = staged(heads.join(shared, "head").groupBy("doc_id").agg(F.collect_set(F.struct("tree", "crowded")).alias("trees")), "live")
    sketches = _of_sets(documents, live.select(F.col("doc_id").alias("_id")), "sketch", sketch)
    turned = F.concat(
        F.substring("signature", F.col("tree") * _HEAD + 1, F.lit(_SIGNATURE)),
        F.substring("signature", F.lit(1), F.col("tree") * _HEAD),
    )
    texts = live.count()
    rows = signed.join(merged_if_large(live, texts, LIVE_BYTES), "doc_id").join(merged_if_large(sketches, texts, ROW_BYTES), "doc_id")
    return rows.select("doc_id", "n_shingles", "signature", "sketch", F.inline("trees")).select(
        "tree", turned.alias("rotated"), "crowded", "doc_id", "n_shingles", "sketch"
    )


def _sorted_trees(rows: DataFrame) -> DataFrame:
    """The rows in the order of (tree, rotated, doc_id), in ranges that cut crowded regions only."""
    head = F.substring("rotated", 1, _HEAD)
    deep = F.when(F.col("crowded"), F.concat("rotated", F.col("doc_id").cast("string").cast("binary")))
    return rows.repartitionByRange(F.col("tree"), head, deep).sortWithinPartitions("tree", "rotated", "doc_id")


def _least_agreement(percent: int) -> int:
    """Bits in which the sketches of a candidate pair agree at least."""
    share = (1 + percent / 100) / 2
    return int(SKETCH_BITS * share - SLACK * (SKETCH_BITS * share * (1 - share)) ** 0.5)


def _neighbours(rows: DataFrame, best_only: bool, percent: int) -> DataFrame:
    """Candidate pairs a < b among rows (tree, rotated, doc_id, n_shingles, sketch, component) in sort order.

    Pairs whose sets' sizes rule the link out are no candidates, nor are pairs whose sketches
    put it SLACK standard errors off. best_only: each row's best neighbour before and after it. Otherwise every candidate whose
    ends have different components.
    """
    least = _least_agreement(percent)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.empty(0, dtype=np.int64)
        sig = np.empty((0, COORDINATES), dtype=np.uint16)
        bits = np.empty((0, SKETCH_BITS // 64), dtype=np.uint64)
        ids, group, size = (np.empty(0, dtype=np.int64) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(ids)
            new = np.frombuffer(b"".join(batch.column("rotated").to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)
            sig = np.concatenate([sig, new])
            new = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, bits.shape[1])
            bits = np.concatenate([bits, new])
            tree = np.concatenate([tree, batch.column("tree").to_numpy()])
            ids = np.concatenate([ids, batch.column("doc_id").to_numpy()])
            group = np.concatenate([group, batch.column("component").to_numpy()])
            size = np.concatenate([size, batch.column("n_shingles").to_numpy()])
            n = len(ids)
            ahead, behind = np.full((n, 2), -1, dtype=np.int64), np.full((n, 2), -1, dtype=np.int64)
            later, pairs = np.arange(old, n), []
            for step in range(1, WINDOW + 1):
                later = later[later >= step]
                earlier = later - step
                same = (tree[later] == tree[earlier]) & (sig[later, :MIN_DEPTH] == sig[earlier, :MIN_DEPTH]).all(axis=1)
                later = later[same]
                if not len(later):
                    break
                earlier = later - step
                fits = 100 * np.minimum(size[later], size[earlier]) >= percent * np.maximum(size[later], size[earlier])
                if best_only:
                    x, y = later[fits], earlier[fits]
                    agree = SKETCH_BITS - np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                    for side, own, other in ((behind, x, y), (ahead, y, x)):
                        better = (agree >= least) & (agree > side[own, 0])
                        side[own[better], 0], side[own[better], 1] = agree[better], other[better]
                else:
                    apart = fits & (group[later] != group[earlier])
                    x, y = later[apart], earlier[apart]
                    near = SKETCH_BITS - np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) >= least
                    pairs.append(np.stack([ids[x[near]], ids[y[near]]], axis=1))
            if best_only:
                for side in (behind, ahead):
                    own = np.flatnonzero(side[:, 1] >= 0)
                    pairs.append(np.stack([ids[own], ids[side[own, 1]]], axis=1))
            if pairs:
                both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
                both = both[both[:, 0] != both[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
            tree, sig, bits, ids, group, size = (column[-WINDOW:] for column in (tree, sig, bits, ids, group, size))

    return rows.select("tree", "rotated", "doc_id", "n_shingles", "sketch", "component").mapInArrow(found, "a long, b long")


def _crowded_regions(rows: DataFrame) -> DataFrame:
    """Regions of the rows (_neighbours) with over WINDOW texts of several components: the largest one, and how many blocks it and the rest take."""
    headed = rows.withColumn("head", F.substring("rotated", 1, _HEAD))
    # Summed by component first, so that a region that many texts share is no task's load.
    parts = headed.groupBy("tree", "head", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    regions = parts.groupBy("tree", "head").agg(F.max(F.struct("n", "component", "w")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    regions = regions.where((F.col("n") > WINDOW) & (F.col("n") > F.col("most.n")))
    blocks = lambda w: F.ceil(w / BLOCK)
    return regions.select(
        "tree", "head", F.col("most.component").alias("largest"), blocks(F.col("most.w")).alias("m_largest"), blocks(F.col("w") - F.col("most.w")).alias("m_others")
    )


def _across_blocks(crowded: DataFrame, percent: int) -> DataFrame:
    """Links a < b that join the components of each crowded region, one at least of each two that a link joins.

    crowded: rows (_neighbours) with their region (_crowded_regions) and hashes, their sets. A
    region's largest component is never compared with itself. The rest is cut into blocks by hash,
    as is the largest component, and each two blocks that can hold a link meet in a task of
    their own, so that no task's load grows with the region. Pairs are screened as candidates are, and
    confirmed on their full sets at once: they are never rows. A pair that shares a region in an
    earlier tree is left to that one.
    """
    least = _least_agreement(percent)
    slot = lambda blocks: F.pmod(F.xxhash64("doc_id"), blocks)
    others, largest = F.col("m_others"), F.col("m_largest")
    is_largest = F.col("component") == F.col("largest")
    own = crowded.withColumn("at", F.when(is_largest, slot(largest)).otherwise(slot(others)))
    meeting = lambda x, y, role: F.struct(x.alias("x"), y.alias("y"), role.alias("role"))
    zero = F.lit(0).cast("long")
    among = F.transform(
        F.sequence(zero, others - 1),
        lambda j: meeting(F.least("at", j), F.greatest("at", j), F.when(F.col("at") < j, 0).when(F.col("at") > j, 1).otherwise(2)),
    )
    against = F.transform(F.sequence(zero, largest - 1), lambda d: meeting(F.col("at"), -1 - d, F.lit(0)))
    large = F.transform(F.sequence(zero, others - 1), lambda x: meeting(x, -1 - F.col("at"), F.lit(1)))
    met = F.when(is_largest, large).otherwise(F.concat(among, against))
    rows = own.select("tree", "head", "rotated", "doc_id", "n_shingles", "sketch", "component", "hashes", F.inline(met))

    def found(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        role = table.column("role").to_numpy()
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)
        turned = np.frombuffer(b"".join(table.column("rotated").to_pylist()), dtype=np.uint16).reshape(-1, ORDERS, MIN_DEPTH)
        earlier = turned[:, ORDERS - tree :]
        ids, size = (table.column(c).to_numpy() for c in ("doc_id", "n_shingles"))
        group, hashes = table.column("component").to_numpy().copy(), table.column("hashes")
        pairs = []
        right = np.flatnonzero(role != 0)
        for i in np.flatnonzero(role != 1):
            mine = np.frombuffer(hashes[i].as_py(), dtype=np.uint64)
            apart = right[(group[right] != group[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
            apart = apart[SKETCH_BITS - np.bitwise_count(bits[apart] ^ bits[i]).sum(axis=1, dtype=np.int64) >= least]
            apart = apart[~(earlier[apart] == earlier[i]).all(axis=2).any(axis=1)]
            for k in apart:
                if group[k] == group[i]:
                    continue
                common = len(np.intersect1d(mine, np.frombuffer(hashes[k].as_py(), dtype=np.uint64), assume_unique=True))
                if common and 100 * common >= percent * (size[i] + size[k] - common):
                    pairs.append(sorted((int(ids[i]), int(ids[k]))))
                    group[group == group[k]] = group[i]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return rows.groupBy("tree", "head", "x", "y").applyInArrow(found, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    ids = staged(ids, "ids")
    texts = documents.select("doc_id", "text").join(_few_or_merged(ids, ID_BYTES), F.col("doc_id") == F.col("_id"), "left_semi")
    texts = staged(texts.dropDuplicates(["doc_id"]), "texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                b_ids, b_texts, rights = part.column("b").to_pylist(), part.column("text_b").to_pylist(), []
                for b, text in zip(b_ids, b_texts, strict=True):
                    if b != last[0]:
                        last = b, shingle_sets([text])[0]
                    rights.append(last[1])
                keep = []
                for x, y in zip(shingle_sets(part.column("text_a").to_pylist()), rights, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    # Texts are of any size, so the second join broadcasts none.
    both = _few_or_merged(pairs, PAIR_BYTES).join(left, "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    links = staged(both.mapInArrow(checked, "a long, b long"), "links")
    for done in (ids, texts):
        discard(documents.sparkSession, done)
    return links


def near_groups(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct
    shingles; component_id is the smallest doc_id reachable. Texts without words, null ones
    too, have n_shingles 0 and are linked with nothing. doc_id is the identity: repeated rows
    share it and their component; rows with a null doc_id are linked with nothing, have a null
    component_id and are kept.
    """
    signed = staged(features(documents), "signatures")
    linkable = signed.where("set_key is not null and doc_id is not null")
    # Equal sets have equal signatures: any one of them stands for all.
    alone = linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    alone = staged(alone, "classes")
    classes = merged_if_large(alone.select("set_key", "rep"), alone.count(), CLASS_BYTES)
    alone = alone.select(F.col("rep").alias("doc_id"), "n_shingles", "signature")

    forest = staged(_forest(alone, documents), "forest")
    first = _neighbours(_sorted_trees(forest.where(F.col("tree") < FIRST_ORDERS).withColumn("component", F.col("doc_id"))), True, percent)
    first = staged(first.distinct(), "pairs")
    links = _confirmed(first, documents, percent)

    def joined(links: DataFrame) -> DataFrame:
        nodes = connected_components(links)
        return merged_if_large(nodes, nodes.count(), EDGE_BYTES)

    found = joined(links)

    component = F.coalesce("component", "doc_id").alias("component")

    def with_components() -> DataFrame:
        return forest.join(found, forest["doc_id"] == found["node"], "left").select(
            "tree", "rotated", "crowded", "doc_id", "n_shingles", "sketch", component
        )

    # Every pair of a thin region is within WINDOW; crowded ones are the third pass's, which makes no rows of pairs.
    second = _neighbours(_sorted_trees(with_components().where(~F.col("crowded"))), False, percent).distinct().join(
        merged_if_large(first, first.count(), PAIR_BYTES), ["a", "b"], "left_anti"
    )
    second = staged(second, "pairs")
    if not second.isEmpty():
        links = links.unionByName(_confirmed(second, documents, percent))
        found = joined(links)

    regions = staged(_crowded_regions(with_components()), "regions")
    if not regions.isEmpty():
        headed = with_components().withColumn("head", F.substring("rotated", 1, _HEAD))
        crowded = staged(headed.join(_few_or_merged(regions, ID_BYTES), ["tree", "head"]), "crowded")
        ids = staged(crowded.select(F.col("doc_id").alias("_id")).distinct(), "ids")
        sets = _of_sets(documents, ids, "hashes", np.ndarray.tobytes)
        large = merged_if_large(crowded, crowded.count(), ROW_BYTES)
        third = staged(_across_blocks(large.join(sets, "doc_id"), percent), "links")
        for done in (crowded, ids):
            discard(documents.sparkSession, done)
        if not third.isEmpty():
            found = joined(links.unionByName(third))

    # The result reads signed, classes and found alone.
    for done in (forest, first, second, regions):
        discard(documents.sparkSession, done)
    return (
        signed.join(classes, "set_key", "left")
        .withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep")))
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_near_copies(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all their columns, of each component the one with the smallest doc_id."""
    groups = staged(near_groups(documents, percent), "groups")
    out = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(_few_or_merged(out, ID_BYTES), F.col("doc_id") == F.col("_id"), "left_anti")


NAME = "op2_near_dedup"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
