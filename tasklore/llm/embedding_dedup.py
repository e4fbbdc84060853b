"""Operator 3, near-duplicate embeddings by counting collisions of one-dimensional projections.

Each of ``tables`` rounds sorts the unit vectors of a label along one random direction; two vectors collide in a round if they lie in each
other's window of that direction. To keep windows short at any table size, a round compares only vectors that share the
cell of a few further directions. Pairs whose number of collisions reaches ``least_collisions`` are verified by their
cosine in double precision. The count is calibrated for recall: at cosine 0.98 a round collides with probability 0.48 (0.886 for each of
six cells, 0.997 for the window), so 3 or more of 14 rounds collide with probability 0.99; closer pairs collide more often.

A pair is handled in the first round in which it collides and nowhere else, so no pairs are shuffled: a round's cell gives the
number of links of each vector and a forest of its links. Equal vectors are one class beforehand. Cells with more rows than a tile are
split by salt into pairs of tiles.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label, link with nothing; so do
vectors of different length. Rows that repeat an id are linked like other vectors. A null id gets no row of its own in any component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import written
from tasklore.llm.components import components, merge

TABLES = 14
GATES = 6
CELL_WIDTH = 1.4
WINDOW = 0.6
LEAST_COLLISIONS = 3
TILE_ROWS = 1024
BUFFER_ROWS = 8192


def directions(size: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions, (1 + GATES) for every round, and the offsets of the gate cells."""
    rng = np.random.default_rng([seed, size])
    return rng.normal(size=(size, TABLES * (1 + GATES))), rng.uniform(0, CELL_WIDTH, (TABLES, GATES))


def project(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and round: the position along the sorted direction (float32) and the cell (a 64-bit hash of the gate steps)."""
    lines, offsets = directions(unit.shape[1])
    values = (unit @ lines).reshape(len(unit), TABLES, 1 + GATES)
    steps = np.floor((values[:, :, 1:] + offsets) / CELL_WIDTH).astype(np.int64).astype(np.uint64)
    cell = np.full(steps.shape[:2], 0x9E3779B97F4A7C15, np.uint64)
    for gate in range(GATES):
        cell = (cell ^ steps[:, :, gate]) * np.uint64(0xC2B2AE3D27D4EB4F)
        cell ^= cell >> np.uint64(29)
    return values[:, :, 0].astype(np.float32), cell.view(np.int64)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def classes(embeddings: DataFrame) -> DataFrame:
    """One row per label and different usable vector: ``class_id`` (its least id), ``copies`` and the vector."""
    x = F.col("embedding")
    usable = F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return embeddings.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))


def rounds(classed: DataFrame) -> DataFrame:
    """One row per class and round: label, round and cell, with the vector as it came; what follows from it is computed again."""
    schema = "label int, size int, round int, cell long, class_id long, copies long, vector binary"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [row.values.to_numpy() for row in batch.column("embedding")]
            sizes = np.array([len(row) for row in vectors])
            for size in np.unique(sizes):
                places = np.flatnonzero(sizes == size)
                _, cells = project(unit_rows(np.stack([vectors[place] for place in places])))
                repeated = np.repeat(places, TABLES)
                label, class_id, copies = (batch.column(name).take(pa.array(repeated)) for name in ("label", "class_id", "copies"))
                raw = pa.array([vectors[place].tobytes() for place in places], pa.binary()).take(pa.array(np.repeat(np.arange(len(places)), TABLES)))
                yield pa.RecordBatch.from_arrays([
                    label, pa.array(np.full(len(repeated), size, np.int32)), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(places))),
                    pa.array(cells.ravel()), class_id, copies, raw],
                    names=["label", "size", "round", "cell", "class_id", "copies", "vector"])

    return classed.select("label", "embedding", "class_id", "copies").mapInArrow(compute, schema)


def tiles(dealt: DataFrame, sizes: DataFrame, tile_rows: int) -> DataFrame:
    """Rows with ``tile`` and ``side``: a cell is one tile (side 2), or is split by salt and its tiles meet in pairs (0 and 1)."""
    keys = ["label", "size", "round", "cell"]
    crowded = written(sizes.filter(F.col("n") > tile_rows).withColumn("salts", F.ceil(F.col("n") / tile_rows).cast("int")), "crowded-cells")
    alone = dealt.join(crowded.select(*keys), keys, "left_anti").withColumn("tile", F.xxhash64(*keys)).withColumn("side", F.lit(2))
    salted = dealt.join(crowded.select(*keys, "salts"), keys).withColumn("salt", F.pmod(F.xxhash64("class_id"), F.col("salts")))
    other = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    met = salted.withColumn("other", other).withColumn("tile", F.xxhash64(
        *keys, F.least("salt", "other"), F.greatest("salt", "other"))).withColumn(
        "side", F.when(F.col("salt") == F.col("other"), 2).when(F.col("salt") < F.col("other"), 0).otherwise(1))
    return alone.unionByName(met.drop("salts", "salt", "other"))


def compare(current: int, side: np.ndarray, unit: np.ndarray, positions: np.ndarray, cells: np.ndarray, copies: np.ndarray,
            threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links in one tile that belong to round ``current``: linked copies per row, and the compressed parents of the forest.

    Rows come sorted along the direction, so the window of each row is a stretch after it.
    """
    order = np.argsort(positions[:, current], kind="stable")
    ends = np.searchsorted(positions[order, current], positions[order, current] + np.float32(WINDOW), "right")
    parents, linked = np.arange(len(order)), np.zeros(len(order), np.int64)
    left_all, right_all = [], []
    for place, end in enumerate(ends.tolist()):
        if end <= place + 1:
            continue
        row, others = order[place], order[place + 1:end]
        if side[row] != 2:
            others = others[side[others] != side[row]]
        collided = (cells[others] == cells[row]) & (np.abs(positions[others] - positions[row]) <= np.float32(WINDOW))
        # This round collides by construction; the pair is its business only if no earlier one does.
        mine = (collided.sum(axis=1) >= LEAST_COLLISIONS) & ~collided[:, :current].any(axis=1)
        others = others[mine]
        others = others[unit[others] @ unit[row] >= threshold]
        if len(others):
            linked[row] += copies[others].sum()
            linked[others] += copies[row]
            left_all.append(np.full(len(others), row))
            right_all.append(others)
            if len(left_all) > 4096:
                merge(parents, np.concatenate(left_all), np.concatenate(right_all))
                left_all, right_all = [], []
    if left_all:
        merge(parents, np.concatenate(left_all), np.concatenate(right_all))
    return linked, parents


def links(dealt: DataFrame, threshold: float, kind: type) -> DataFrame:
    """Per tile and row with links: ``class_id``, ``linked`` (vectors) and ``root_id`` (a class it reaches in the tile)."""
    names = ["tile", "side", "round", "class_id", "copies", "vector"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def flush(rows: pa.Table) -> pa.RecordBatch:
            ids, found, roots = [], [], []
            tile = rows.column("tile").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
            for begin, end in zip(borders[:-1], borders[1:], strict=True):
                if end - begin > 1:
                    part = rows.slice(begin, end - begin)
                    unit = unit_rows(np.stack([np.frombuffer(value, kind) for value in part.column("vector").to_pylist()]))
                    positions, cells = project(unit)
                    own = part.column("class_id").to_numpy()
                    linked, parents = compare(part.column("round")[0].as_py(), part.column("side").to_numpy(), unit, positions, cells,
                                              part.column("copies").to_numpy(), threshold)
                    some = np.flatnonzero(linked)
                    ids.append(own[some])
                    found.append(linked[some])
                    roots.append(own[parents[some]])
            columns = [np.concatenate(values) if values else np.zeros(0, np.int64) for values in (ids, found, roots)]
            return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=["class_id", "linked", "root_id"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, new]) if rest is not None else new
            if rest.num_rows >= BUFFER_ROWS:
                tile = rest.column("tile").to_numpy()
                cut = int(np.flatnonzero(tile != tile[-1])[-1]) + 1 if (tile != tile[-1]).any() else 0
                if cut:
                    yield flush(rest.slice(0, cut))
                    rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield flush(rest)

    return dealt.select(*names).repartition("tile").sortWithinPartitions("tile").mapInArrow(search, "class_id long, linked long, root_id long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    classed = written(classes(embeddings), "vector-classes")
    dealt = rounds(classed)
    # Only the keys are written: the rows themselves are cheaper to compute again than to keep ``tables`` times.
    sizes = written(dealt.groupBy("label", "size", "round", "cell").agg(F.count("*").alias("n")), "cell-sizes")
    kind = np.float32 if dict(classed.dtypes)["embedding"] == "array<float>" else np.float64
    found = written(links(tiles(dealt, sizes, tile_rows), threshold, kind), "vector-links")
    totals = found.groupBy("class_id").agg(F.sum("linked").alias("linked"))
    joined = components(found.select(F.col("class_id").alias("left_node"), F.col("root_id").alias("right_node"))).withColumnRenamed("node", "class_id")
    known = classed.select("label", "embedding", "class_id", "copies").join(totals, "class_id", "left").join(joined, "class_id", "left").select(
        "label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    return embeddings.select("vec_id", "label", "embedding").join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
