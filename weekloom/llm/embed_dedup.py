"""Near-duplicate vectors by spherical k-means cells.

Exact copies are collapsed first. Spherical k-means, fitted on a bounded sample, gives centroids; each vector belongs to
its nearest cell and also visits the cells whose boundary with its own is near. Within cells and labels, blocked cosine
products find the links. A link between two cells is found where either end visits the other's cell, and is counted once
for each end: in that end's own cell if the other end is there, else in the other's. Cells of any size are dealt out as
tiles; a tile returns counts of links and a spanning forest of them, never the pairs.

Tables that want more than MOST_CELLS cells get two levels: each cell of the first one, with its visitors, is parted once
more by centroids of its own, fitted on a bounded sample of it, and the same rules hold within it. So cells keep their
size while the table grows. Centroids of the second level travel to the vectors as rows of their cell.

A pair of cosine c lies at most sqrt(2 - 2c) apart. If a boundary is between the two, their distances to it add up to no
more than that, and the smaller one is at most half of it, sqrt((1 - c) / 2): that end visits the other's cell. The
margin is this bound for the least cosine, so no link is lost, whatever the vectors' directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import forest, settle, spread_join, tiled
from weekloom.llm.graph import components
from weekloom.llm.vectors import clean, matrix

LEAST_COSINE = 0.93
#: Against rounding of the difference between two cosines.
SLACK = 1e-9
#: Vectors that centroids are fitted on, about, at most (all are indexed), vectors of a label that a cell should hold, most
#: cells of a level, and cells that also small tables have, of some vectors each.
SAMPLE, CELL, MOST_CELLS, LEAST_CELLS, SMALL_CELL = 16_384, 256, 1024, 8, 64
#: Bytes of the vectors that centroids are fitted on: of wide ones fewer are taken. Vectors that are placed at a time.
SAMPLE_BYTES, PLACED = 64 << 20, 1024
#: Vectors of a first-level cell that meet its centroids in one task.
CHUNK = 65_536
TILE = 1024


def exact_margin(least: float) -> float:
    """Distance to a boundary within which one end of each link across it lies."""
    return max(0.0, (1 - least) / 2) ** 0.5


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit rows; starts from rows spread over x, an empty cell keeps its centroid."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _some(n: Column, sample: Column) -> Column:
    """Whether a row's hash is in the first sample / n of its range."""
    return F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.least(F.lit(1.0), sample / n) * F.lit(float(1 << 30))


def _sampled(dim: Column) -> Column:
    """About how many vectors of so many components centroids are fitted on."""
    return F.least(F.lit(SAMPLE), F.floor(F.lit(SAMPLE_BYTES) / (dim * 8)))


def fit(vectors: DataFrame, n: int, cells: int) -> dict[int, np.ndarray]:
    """Centroids for each dimension, from a sample of the n rows (vec_id, dim, vec), chosen by hash."""
    by_dim: dict[int, list[bytes]] = {}
    for r in sorted(vectors.filter(_some(F.lit(max(n, 1)), _sampled(F.col("dim")))).select("vec_id", "dim", "vec").collect()):
        by_dim.setdefault(r.dim, []).append(bytes(r.vec))
    return {dim: spherical_kmeans(unit(np.frombuffer(b"".join(some), np.float64).reshape(-1, dim)), max(1, min(cells, len(some) // 8))) for dim, some in by_dim.items()}


def apart(centres: np.ndarray) -> np.ndarray:
    """Distances of unit centroids, from their products; rounding only makes them larger."""
    return np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)) + 1e-11)


def _places(x: np.ndarray, centres: np.ndarray, between: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cell of each vector, and all that it visits, its own too. between: apart(centres)."""
    home, visits = np.zeros(len(x), np.int32), []
    for at in range(0, len(x), PLACED):
        near = unit(x[at : at + PLACED]) @ centres.T
        own = near.argmax(axis=1)
        close = near[np.arange(len(own)), own][:, None] - near <= margin * between[own] + SLACK
        close[np.arange(len(own)), own] = True
        home[at : at + PLACED] = own
        visits += [np.flatnonzero(c).astype(np.int32) for c in close]
    return home, visits


def _with_places(batch: pa.RecordBatch, home: np.ndarray, visits: list, level: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, f"{level}home", f"{level}visits"])


def _assign(centres: dict[int, np.ndarray], margin: float, level: str = ""):
    """Rows with their cell and the cells they visit, by broadcast centroids of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            home, visits = np.zeros(len(dims), np.int32), np.full(len(dims), None)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                own, seen = [0] * len(rows), [[0]] * len(rows)
                if dim in centres:
                    if dim not in between:
                        between[dim] = apart(centres[dim])
                    own, seen = _places(matrix(batch.column("vec").take(pa.array(rows))), centres[dim], between[dim], margin)
                home[rows] = own
                visits[rows] = np.fromiter(seen, object, len(seen))
            yield _with_places(batch, home, visits.tolist(), level)

    return run


def _fit_cell(table: pa.Table) -> pa.Table:
    """Centroids of a first-level cell, from its sample; of a cell with n members, a row each."""
    rows = sorted(zip(table.column("vec_id").to_pylist(), table.column("vec").to_pylist()))
    x = unit(np.frombuffer(b"".join(v for _, v in rows), np.float64).reshape(len(rows), -1))
    cells = -(-table.column("largest")[0].as_py() // CELL)
    centres = spherical_kmeans(x, max(1, min(cells, MOST_CELLS, len(rows) // 8)))
    return table.select(["dim", "area", "chunks"]).slice(0, 1).append_column("vec", pa.array([centres.tobytes()], pa.binary()))


def _assign_within(margin: float):
    """Rows come sorted by (dim, area, chunk, side): the centroids of a first-level cell, then its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = between = np.zeros((1, 1))
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "area", "chunk", "side")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if b > a and keys[a, 3] == 0:
                    centres = np.frombuffer(part.column("vec")[0].as_py(), np.float64).reshape(-1, int(keys[a, 0]))
                    between = apart(centres)
                elif b > a:
                    yield _with_places(part.drop_columns(["chunk", "side"]), *_places(matrix(part.column("vec")), centres, between, margin), "")

    return run


_MEMBER = "vec_id long, label string, dim int, vec binary, copies long, area int, outer_home int, outer_visits array<int>"


def _two_levels(reps: DataFrame, n: int, margin: float) -> DataFrame:
    """reps once for each first-level cell (area) that they visit, with their places within it."""
    coarse = fit(reps, n, MOST_CELLS)
    outer = reps.mapInArrow(_assign(coarse, margin, "outer_"), "vec_id long, label string, dim int, vec binary, copies long, outer_home int, outer_visits array<int>")
    members = settle(outer.withColumn("area", F.explode("outer_visits")).select("vec_id", "label", "dim", "vec", "copies", "area", "outer_home", "outer_visits"))
    sizes = members.groupBy("dim", "area", "label").agg(F.count("*").alias("n")).groupBy("dim", "area").agg(F.sum("n").alias("n"), F.max("n").alias("largest"))
    sizes = settle(sizes.withColumn("chunks", F.ceil(F.col("n") / CHUNK)))
    chosen = members.join(sizes, ["dim", "area"]).filter(_some(F.col("n"), _sampled(F.col("dim")))).select("dim", "area", "chunks", "largest", "vec_id", "vec")
    centres = chosen.groupBy("dim", "area").applyInArrow(_fit_cell, "dim int, area int, chunks long, vec binary")
    centres = centres.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    dealt = members.join(sizes.select("dim", "area", "chunks"), ["dim", "area"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks")).drop("chunks").withColumn("side", F.lit(1))
    both = dealt.unionByName(centres.withColumn("side", F.lit(0)), allowMissingColumns=True).repartition("dim", "area", "chunk").sortWithinPartitions("dim", "area", "chunk", "side")
    both = both.select("vec_id", "label", "dim", "vec", "copies", "area", "outer_home", "outer_visits", "chunk", "side")
    return both.mapInArrow(_assign_within(margin), f"{_MEMBER}, home int, visits array<int>")


def _spanned(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of a tile: of few links by union-find, of many by spreading the smallest id."""
    i, j = np.nonzero(linked)
    if len(i) <= 16 * (len(left) + len(right)):
        return forest(zip(left[i].tolist(), right[j].tolist()))
    a, b, top = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        low = np.where(linked, b[None, :], top).min(axis=1, initial=top)
        new_a = np.minimum(a, low)
        new_b = np.minimum(b, np.where(linked, new_a[:, None], top).min(axis=0, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    return [(int(x), int(m)) for ids, low in ((left, a), (right, b)) for x, m in zip(ids, low) if x != m]


def _goes(visits: pa.ChunkedArray, cells: np.ndarray) -> np.ndarray:
    """Whether each row, by its visits, goes to each of some cells."""
    lists = visits.combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()[lists.offsets[0].as_py() :]
    out = np.zeros((len(lists), int(max(flat.max(initial=0), cells.max(initial=0))) + 1), bool)
    out[np.repeat(np.arange(len(lists)), np.diff(at)), flat[: at[-1] - at[0]]] = True
    return out[:, cells]


def _tile(least: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        left, right = (table.filter(pa.array(side == s)) for s in (0, 1))
        if not left.num_rows or not right.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        a, b = ({c: t.column(c).to_numpy() for c in ("vec_id", "copies", "home", "outer_home")} for t in (left, right))
        cell, area = left.column("cell")[0].as_py(), left.column("area")[0].as_py()
        x, y = (unit(matrix(t.column("vec"))) for t in (left, right))
        linked = (x @ y.T >= least) & (a["vec_id"][:, None] != b["vec_id"][None, :])
        at_home = a["outer_home"] == area, b["outer_home"] == area
        linked &= at_home[0][:, None] | at_home[1][None, :]  # two visitors of an area meet in one of their own
        # an end of a link is counted in its own area if the other end goes there, else here; so it is with cells
        here_a = here_b = linked
        if not (at_home[0].all() and at_home[1].all()):
            here_a = linked & (at_home[0][:, None] | ~_goes(right.column("outer_visits"), a["outer_home"]).T)
            here_b = linked & (at_home[1][None, :] | ~_goes(left.column("outer_visits"), b["outer_home"]))
        counts: dict[int, int] = {}
        n = (here_a * b["copies"][None, :]).sum(axis=1)
        for v, c in zip(a["vec_id"][n > 0].tolist(), n[n > 0].tolist()):
            counts[v] = counts.get(v, 0) + c
        guests = np.flatnonzero((b["home"] != cell) & here_b.any(axis=0))
        if len(guests):
            m = ((here_b[:, guests] & ~_goes(left.column("visits"), b["home"][guests])) * a["copies"][:, None]).sum(axis=0)
            for v, c in zip(b["vec_id"][guests][m > 0].tolist(), m[m > 0].tolist()):
                counts[v] = counts.get(v, 0) + c
        edges = _spanned(linked, a["vec_id"], b["vec_id"])
        u = [*counts, *(e[0] for e in edges)]
        v = pa.array([*[None] * len(counts), *(e[1] for e in edges)], pa.int64())
        return pa.table({"u": pa.array(u, pa.int64()), "v": v, "n": pa.array([*counts.values(), *[0] * len(edges)], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, label: str = "label", margin: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, they have the same length, and their cosine is at least least.
    n_links counts the other vectors linked directly, exact copies among them; component_id is the smallest vec_id
    reachable; kept marks it. A vec_id names one vector: rows that repeat it are returned each, and count once. Unusable
    vectors (null, zero, null or non-finite components) and those without label link with nothing and are kept; a row
    without vec_id has null for component_id and kept. Other columns are ignored. The default margin is exact for least;
    a smaller one visits fewer cells and may lose links.
    """
    margin = exact_margin(least) if margin is None else margin
    base = settle(clean(vectors, label).filter(F.col("label").isNotNull()).distinct())
    reps = settle(base.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    reps = reps.select("vec_id", "label", "dim", "vec", "copies")
    size = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    n, most = size["all"] or 0, size["most"] or 0
    wanted = max(-(-most // CELL), min(LEAST_CELLS, n // SMALL_CELL))
    if wanted > MOST_CELLS:
        cells = _two_levels(reps, n, margin)
    else:
        one = reps.select("*", F.lit(0).alias("area"), F.lit(0).alias("outer_home"), F.array(F.lit(0)).alias("outer_visits"))
        cells = one.mapInArrow(_assign(fit(reps, n, wanted), margin), f"{_MEMBER}, home int, visits array<int>")
    cells = settle(cells)
    keys = ["label", "dim", "area", "cell"]
    columns = [*keys, "vec_id", "vec", "copies", "home", "visits", "outer_home", "outer_visits"]
    homes = cells.withColumn("cell", F.col("home")).select(*columns)
    guests = cells.withColumn("cell", F.explode("visits")).select(*columns)
    found = tiled(homes, guests, keys, "vec_id", TILE).groupBy(*keys, "ti", "tj").applyInArrow(_tile(least), "u long, v long, n long")
    found = settle(found)
    counts = found.filter(F.col("v").isNull()).groupBy("u").agg(F.sum("n").alias("n"))
    classes = components(found.filter(F.col("v").isNotNull()).select("u", "v"))
    of_rep = reps.join(counts, reps["vec_id"] == counts["u"], "left").join(classes, reps["vec_id"] == classes["node"], "left")
    of_rep = of_rep.select("label", "dim", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    of_row = spread_join(base, of_rep, ["label", "dim", "vec"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = settle(vectors.select(F.col("vec_id").cast("long").alias("vec_id")))
    out = spread_join(ids.filter(F.col("vec_id").isNotNull()), of_row, ["vec_id"], "left")
    out = out.select("vec_id", "n_links", "component_id").unionByName(ids.filter(F.col("vec_id").isNull()), allowMissingColumns=True)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
