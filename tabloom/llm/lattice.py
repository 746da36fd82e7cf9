"""Embedding near-duplicates by lattice hashing: random projections decoded to points of the E8 lattice, with probing.

In each table a vector is projected to three times eight dimensions, and each eight are decoded to the nearest point of the
E8 lattice; the three points are its home cell. It also visits the cells around its home that lie nearest to it. Two vectors
meet in every cell that is the home of one and is visited by the other, and there their cosine is computed in double precision.

Equal vectors are folded first. A pair may meet in several cells; it counts in the one with the least key, which follows
from the two vectors alone, so no list of pairs is ever made: a cell hands on one row per vector, with its number of links
and one neighbour of its group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import mix, only, stored
from tabloom.llm.graph import components

#: Tables, eight-dimensional points of a cell, cells visited in a table (its home included), and the lattice's scale for
#: coordinates of standard deviation 1/8. A pair of cosine 0.95 meets in one table with probability 0.65, in no table 0.0006.
TABLES, POINTS, VISITS, SCALE = 7, 3, 8, 0.35
#: Lattice points considered around each decoded one, itself included.
AROUND = 4
#: Rows of a bin of small cells, rows of a block of a large one, and the size from which a cell is compared by one product.
BIN_ROWS, BLOCK_ROWS, SMALL = 8192, 1024, 24
PAIRS = 1 << 16
_LAST = np.iinfo(np.int64).max
_PLANS: dict[tuple, tuple] = {}


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd turn the least certain coordinate round."""
    near = np.rint(y)
    rest = y - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of the even integer points and those moved by one half, whichever is nearer."""
    one, two = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - one) ** 2).sum(axis=1) <= ((y - two) ** 2).sum(axis=1))[:, None], one, two)


def _plan(size: int, tables: int, points: int, visits: int) -> tuple:
    """Projections for vectors of a size, offsets, and the combinations of neighbouring points of a cell."""
    if (size, tables, points, visits) not in _PLANS:
        random = np.random.default_rng([13, size])
        wide = 8 * points
        turns = []
        for _ in range(tables):
            g = random.normal(size=(size, wide)) / 8
            turns.append(np.linalg.qr(g)[0] * np.sqrt(size) / 8 if size >= wide else g)
        offsets = random.random((tables, wide)) * 2
        several = np.array(list(itertools.product(range(AROUND), repeat=points)))
        factors = random.integers(1, 1 << 62, (tables, points, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _PLANS[size, tables, points, visits] = turns, offsets, several, factors, roots()
    return _PLANS[size, tables, points, visits]


def cell_keys(vectors: np.ndarray, tables: int = TABLES, points: int = POINTS, visits: int = VISITS, scale: float = SCALE) -> np.ndarray:
    """(vectors, tables, visits) keys of the cells that unit vectors visit, the home first."""
    n, size = vectors.shape
    turns, offsets, several, factors, around = _plan(size, tables, points, visits)
    out = np.empty((n, tables, min(visits, len(several))), np.int64)
    for t in range(tables):
        # rounded, and summed in one order, so that a vector has the same cells wherever it is hashed
        y = np.round(np.einsum("ij,jk->ik", vectors, turns[t]) / scale + offsets[t], 9).reshape(n * points, 8)
        home = decode(y)
        inner = (y - home) @ around.T
        near = np.argpartition(-inner, AROUND - 2, axis=1)[:, : AROUND - 1]
        # how much further each of these is than the home, squared
        gaps = np.concatenate((np.zeros((len(y), 1)), 2 - 2 * np.take_along_axis(inner, near, 1)), axis=1).reshape(n, points, AROUND)
        cells = np.concatenate((home[:, None], home[:, None] + around[near]), axis=1).reshape(n, points, AROUND, 8)
        twice = np.rint(cells * 2).astype(np.int64).astype(np.uint64)
        codes = mix((twice * factors[t][None, :, None, :]).sum(axis=3, dtype=np.uint64) + np.arange(1, points + 1, dtype=np.uint64)[None, :, None])
        total = np.round(sum(gaps[:, k][:, several[:, k]] for k in range(points)), 9)
        first = np.argsort(total, axis=1, kind="stable")[:, : out.shape[2]]  # all zeros is the home, and stands first
        key = np.full((n, out.shape[2]), size * 1000 + t + 1, np.uint64)
        for k in range(points):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.take_along_axis(codes[:, k], several[first][:, :, k], 1))
        out[:, t] = key.astype(np.int64)
    return out


def unit(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) for each size of vector in a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        v = flat[starts[rows][:, None] + np.arange(size)]
        v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square leaves the range
        out.append((rows, v / np.sqrt((v * v).sum(axis=1, keepdims=True))))
    return out


def pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within runs of the given sizes."""
    ends = np.cumsum(sizes)
    end_of = np.repeat(ends, sizes)
    at = np.arange(len(end_of))
    mates = end_of - at - 1
    x = np.repeat(at, mates)
    return x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(mates) - mates, mates)


def grouped(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least position in each position's connected group."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def meets(vectors: np.ndarray, home: np.ndarray, cell: np.ndarray, block: np.ndarray, across: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell, one of them at home, that reach the cosine. Rows come sorted by cell; of cells marked ``across`` only pairs of different blocks."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cell)])))
    found_x, found_y = [], []

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        use = (home[x] | home[y]) & ~(across[x] & (block[x] == block[y]))
        x, y = x[use], y[use]
        for i in range(0, len(x), PAIRS):
            a, b = x[i: i + PAIRS], y[i: i + PAIRS]
            close = (vectors[a] * vectors[b]).sum(axis=1) >= least
            found_x.append(a[close])
            found_y.append(b[close])

    small = sizes <= SMALL
    rows = np.flatnonzero(np.repeat(small, sizes))
    x, y = pairs_of(sizes[small])
    keep(rows[x], rows[y])
    for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
        for i in range(0, n, BLOCK_ROWS):
            one = vectors[s + i: s + min(i + BLOCK_ROWS, n)]
            x, y = np.nonzero(one @ vectors[s + i: s + n].T >= least - 1e-9)
            keep(s + i + x[x < y], s + i + y[x < y])
    return np.concatenate(found_x or [np.zeros(0, np.int64)]), np.concatenate(found_y or [np.zeros(0, np.int64)])


def counts_here(keys: np.ndarray, x: np.ndarray, y: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether a pair's cell is the one of least key among all where it meets. ``keys`` as from :func:`cell_keys`."""
    out = np.zeros(len(x), bool)
    step = max(1, PAIRS // 4)
    for i in range(0, len(x), step):
        a, b = keys[x[i: i + step]], keys[y[i: i + step]]
        one = np.where((a[:, :, :1] == b).any(axis=2), a[:, :, 0], _LAST).min(axis=1)
        two = np.where((b[:, :, :1] == a).any(axis=2), b[:, :, 0], _LAST).min(axis=1)
        out[i: i + step] = np.minimum(one, two) == cell[i: i + step]
    return out


def proper(vector: Column) -> Column:
    """Vectors that can be compared: no null or non-finite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def cell_links(classes: DataFrame, percent: float, tables: int, points: int, visits: int, scale: float) -> DataFrame:
    """(id, links, to): for the vectors with links, parts of their weighed number and a vector of their group."""
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                ids = batch["id"].to_numpy()
                for rows, vectors in unit(batch["v"]):
                    keys = cell_keys(vectors, tables, points, visits, scale)
                    n, _, many = keys.shape
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(ids[rows], tables * many)), pa.array(np.tile(np.arange(many) == 0, n * tables))],
                        names=["key", "id", "home"])

    visits_of = stored(classes.select("id", "v").mapInArrow(visit, "key long, id long, home boolean"))
    live = visits_of.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 AND any").select("key", "n")
    members = stored(visits_of.join(live, "key"))
    bins = members.agg(F.ceil(F.count("*") / BIN_ROWS)).first()[0] or 1
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    members = members.withColumn("of", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    with_block = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    members = members.withColumn("with", with_block).select(
        "key", "id", "home", "block", (F.col("of") > 1).alias("large"), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
        F.when(F.col("of") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(bins))).alias("bin"))
    members = members.join(classes.select("id", "v", "weight"), "id")
    least = percent / 100

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        cell, ids, weight, block = (table[c].to_numpy() for c in ("key", "id", "weight", "block"))
        home, large = (table[c].to_numpy(zero_copy_only=False) for c in ("home", "large"))
        across = large & (table["i"].to_numpy() != table["j"].to_numpy())
        to, links = ids.copy(), np.zeros(len(ids), np.int64)
        for rows, vectors in unit(table["v"].chunk(0)):
            x, y = meets(vectors, home[rows], cell[rows], block[rows], across[rows], least)
            if not len(x):
                continue
            used, at = np.unique(np.concatenate((x, y)), return_inverse=True)
            a, b = at[: len(x)], at[len(x):]
            keys = np.concatenate([cell_keys(vectors[used[i: i + 1024]], tables, points, visits, scale) for i in range(0, len(used), 1024)])
            here = counts_here(keys, a, b, cell[rows[x]])
            x, y = x[here], y[here]
            np.add.at(links, rows[x], weight[rows[y]])
            np.add.at(links, rows[y], weight[rows[x]])
            to[rows] = ids[rows[grouped(len(rows), x, y)]]
        use = links > 0
        return pa.table({"id": ids[use], "links": links[use], "to": to[use]})

    return stored(members.groupBy("bin", "large", "i", "j").applyInArrow(compare, "id long, links long, to long"))


def near_vectors(rows: DataFrame, percent: float = 95, vector: str = "embedding", key: str = "vec_id", tables: int = TABLES, points: int = POINTS,
                 visits: int = VISITS, scale: float = SCALE) -> DataFrame:
    """Per row: key, n_links (other rows whose cosine reaches the similarity, of those found), component_id (smallest key reachable), kept (key = component_id).

    Vectors that are null or empty, all zero, or hold null or non-finite components link with nothing. Equal vectors link
    with each other, whatever their keys; vectors of different sizes never do. A null key takes no part in the smallest
    key; a component of null keys alone has a null id and its rows are kept. Rows with equal keys are rows of their own.
    An empty table gives none. Other columns are ignored.
    """
    slim = only(rows, *dict.fromkeys((key, vector))).select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").alias("v"))
    good = proper(F.col("v"))
    # two independent 64-bit hashes name a vector
    named = slim.select("k", F.when(good, F.col("v")).alias("v")).select(
        "k", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("second"), "v")).alias("g"))
    classes = named.where("v IS NOT NULL").groupBy("h", "g").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("k").alias("least"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()))
    found = cell_links(classes, percent, tables, points, visits, scale)
    labels = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.drop("v").join(sums, "id", "left").join(labels.withColumnRenamed("v", "id"), "id", "left").where("weight > 1 OR links > 0")
    of_class = of_class.withColumn("label", F.coalesce("label", "id"))
    least = of_class.groupBy("label").agg(F.min("least").alias("component"))
    facts = of_class.join(least, "label").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component", F.lit(True).alias("linked"))
    out = named.drop("v").join(facts, ["h", "g"], "left")
    component = F.when(F.col("linked"), F.col("component")).otherwise(F.col("k"))
    return out.select(F.col("k").alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"))
