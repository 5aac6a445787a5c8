"""Vectors in cells around centres: approximate and exact nearest neighbours, and near duplicates without a scope.

Centres are fitted by spherical k-means on a sample of about SAMPLE vectors, told by the hash of their ids; there are at
most CENTRES, so all that is sent to tasks or comes to the driver has a fixed size. Every vector is put into the cell
of its nearest centre, whose radius is the largest angle in it. Cells are dealt in slices of about SLICE vectors, so a
cell of a third of all vectors is many tasks' work, and products within a task are matrix products.

`nearest` asks the cells of the nearest centres. How many is found when centres are fitted: the least number of cells
that hold a share of TARGET of the true neighbours of the sample's own vectors. `exact_nearest` goes on from there: a vector
of a cell is at least (angle to the centre - radius) away, so only cells that can hold a neighbour as near as the
k-th found are asked, and the result is that of a comparison with every vector.

`near_pairs` finds all pairs of an angle up to a threshold. Equal vectors are one representative (their smallest id)
first, and its pairs are said for all of them at the end if every pair is asked for. A vector stays in its own cell, and is sent as a guest to another cell only if the half-space nearer to that
cell's centre and the cell's radius both come within the threshold; of two cells only one gets the other's guests, so a pair
is met once. Far pairs are never met as far as centres part them. Where a sample shows that vectors would go to many of the
cells, as those without any structure do, one cell takes all and its blocks are compared pair by pair: each vector is then sent
once for each block of up to BLOCK vectors.

Null and empty vectors, and vectors of another length than most, are in no cell; vectors of norm 0 have no direction and
are left out as well, as their cosine counts as 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import vector as V
from sparkloom.operators.ranking import top_k
from sparkloom.sources.stored import cut

SAMPLE = 20_000
CENTRES = 1024
SLICE = 20_000
STRIP = 512
TARGET = 0.95
NEIGHBOURS = 20
STEPS = 12
SLACK = 1e-6  # of an angle, for rounding


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def units(vectors: DataFrame, key: str, vector: str = "vector") -> tuple[DataFrame, int]:
    """(key, v) with v of norm 1 in double precision, and the length that most vectors have."""
    sizes = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes.n if sizes else 0
    whole = vectors.filter((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))))
    return whole.select(key, V.normalised(F.col(vector)).alias("v")).filter(F.exists("v", lambda x: x != 0) & ~F.exists("v", F.isnan)), dim


def padded(vectors: DataFrame) -> DataFrame:
    """Vectors of one length, the longest's: elements that are missing or null count as 0."""
    dim = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    each = F.sequence(F.lit(0), F.lit(max(0, dim - 1)))
    return vectors.filter(F.size("vector") > 0).withColumn("vector", F.transform(each, lambda i: F.coalesce(F.get("vector", i), F.lit(0.0))))


def close(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the rows of norm 1 whose product (in millionths) is at least the threshold. Single precision finds
    the candidates, with room for its errors, and double precision decides."""
    few, many, least = a.astype(np.float32), b.astype(np.float32), np.float32(threshold - 2e-6 - 2e-7 * (a.shape[1] + 8))
    found = [np.zeros((3, 0), np.int64)]
    for x in range(0, len(a), STRIP):
        i, j = np.divmod(np.flatnonzero((few[x : x + STRIP] @ many.T).ravel() >= least), max(1, len(b)))
        for y in range(0, len(i), 65_536):
            p, q = i[y : y + 65_536] + x, j[y : y + 65_536]
            score = np.floor(np.einsum("nd,nd->n", a[p], b[q]) * 1_000_000 + 0.5).astype(np.int64)
            fit = score >= int(threshold * 1_000_000)
            found.append(np.stack((p[fit], q[fit], score[fit])))
    return tuple(np.concatenate(found, axis=1))


def sampled(rows: DataFrame, key: str, total: int, most: int) -> np.ndarray:
    """About `most` of the vectors, by the hash of their ids."""
    share = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, most / max(1, total)))
    found = [r.v for r in rows.filter(share).orderBy(F.xxhash64(key), key).limit(2 * most).select("v").collect()]
    return np.array(found, np.float64)


def fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of norm 1; a centre that loses its last vector stays where it was."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(STEPS):
        home = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, target: float = TARGET, k: int = NEIGHBOURS) -> int:
    """How many of the nearest cells hold a share of `target` of the sample's nearest neighbours."""
    asked = sample[:500]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    home = np.argmax(sample @ centres.T, axis=1)
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    places = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel())
    return int(places[min(len(places) - 1, math.ceil(target * len(places)) - 1)]) + 1 if len(places) else 1


@dataclass
class Cells:
    """rows: (cell, slice, doc, v). Of each cell: centre, number of vectors, radius (an angle)."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    probes: int

    def slices(self, cell: Column) -> Column:
        return F.element_at(F.lit([max(1, -(-int(n) // SLICE)) for n in self.sizes]), cell + 1)


def build(vectors: DataFrame, path: str, centres: int | None = None) -> dict[str, str]:
    """Write the cells of (doc, vector)."""
    rows, dim = units(vectors, "doc")
    total = rows.count()
    sample = sampled(rows, "doc", total, SAMPLE) if total else np.zeros((0, max(1, dim)))
    n = centres or max(1, min(CENTRES, round(4 * math.sqrt(total)), len(sample) // 16))
    middle = fitted(sample, n) if len(sample) else np.zeros((0, max(1, dim)))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                dots = _matrix(batch.column(1), dim) @ middle.T
                cell = np.argmax(dots, axis=1)
                angle = np.arccos(np.clip(dots[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle), batch.column(0), batch.column(1)], names=["cell", "angle", "doc", "v"])

    spark = vectors.sparkSession
    if len(middle):
        placed = rows.select(F.col("doc").cast("long").alias("doc"), "v").mapInArrow(assign, "cell int, angle double, doc long, v array<double>")
    else:
        placed = spark.createDataFrame([], "cell int, angle double, doc long, v array<double>")
    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed.repartition(many, "cell", F.pmod(F.xxhash64("doc"), F.lit(16))).sortWithinPartitions("cell").write.option("compression", "zstd").parquet(f"{path}/rows")
    stats = {r.cell: r for r in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    table = [(i, [float(x) for x in c], stats[i].n if i in stats else 0, stats[i].radius if i in stats else 0.0) for i, c in enumerate(middle)]
    spark.createDataFrame(table, "cell int, centre array<double>, n long, radius double").coalesce(1).write.parquet(f"{path}/centres")
    return {"probes": str(probes_for(sample, middle) if len(middle) else 0), "vectors": str(total)}


def opened(spark, path: str) -> Cells:
    m = spark.read.json(f"{path}/manifest").first()
    table = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    cells = Cells(spark.read.parquet(f"{path}/rows"), np.array([r.centre for r in table]), np.array([r.n for r in table], np.int64), np.array([r.radius for r in table]), int(m.probes))
    if len(table):
        cells.rows = cells.rows.withColumn("slice", F.pmod(F.xxhash64("doc"), cells.slices(F.col("cell"))).cast("int"))
    return cells


def asked_cells(cells: Cells, queries: DataFrame, probes: int) -> DataFrame:
    """(query, v, cell, bound): the cells to be asked, and the score that still matters. A column `least` (the cosine that still
    matters) asks all cells that can hold as near a vector, else the nearest `probes` are asked."""
    reach, middle, radii = "least" in queries.columns, cells.centres, cells.radii

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                dots = _matrix(batch.column(1), middle.shape[1]) @ middle.T
                if reach:
                    angle = np.maximum(0, np.arccos(np.clip(dots, -1, 1)) - radii[None, :] - SLACK)
                    row, cell = np.nonzero((np.cos(angle) >= batch.column(2).to_numpy()[:, None]) & (cells_n > 0)[None, :])
                else:
                    cell = np.argsort(-dots, axis=1, kind="stable")[:, :probes].ravel()
                    row = np.repeat(np.arange(batch.num_rows), len(cell) // batch.num_rows)
                took = batch.take(pa.array(row))
                bound = np.floor(batch.column(2).to_numpy()[row] * 1_000_000) if reach else np.zeros(len(row))
                yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(cell, pa.int32()), pa.array(np.maximum(1, bound).astype(np.int64))], names=["query", "v", "cell", "bound"])

    cells_n = cells.sizes
    return queries.select("query", "v", *(["least"] if reach else [])).mapInArrow(run, "query long, v array<double>, cell int, bound long")


def _scored(cells: Cells, asked: DataFrame, k: int) -> DataFrame:
    """The best k of each query among the vectors of the cells that it asks, by slices, of those that reach its bound."""
    dim = cells.centres.shape[1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((3, 0), np.int64)]
        if left.num_rows and right.num_rows:
            own, docs = _matrix(right["v"].combine_chunks(), dim), right["doc"].to_numpy()
            for a in range(0, left.num_rows, 256):
                part = left.slice(a, 256)
                score = np.floor(_matrix(part["v"].combine_chunks(), dim) @ own.T * 1_000_000 + 0.5).astype(np.int64)
                row, at = np.nonzero(score >= part["bound"].to_numpy()[:, None])
                score = score[row, at]
                order = np.lexsort((docs[at], -score, row))
                row, at, score = row[order], at[order], score[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(np.stack((part["query"].to_numpy()[row[best]], docs[at[best]], score[best])))
        return pa.table(dict(zip(("query", "doc", "score"), np.concatenate(out, axis=1), strict=True)))

    sent = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), cells.slices(F.col("cell")) - 1)))
    return sent.groupBy("cell", "slice").cogroup(cells.rows.select("cell", "slice", "doc", "v").groupBy("cell", "slice")).applyInArrow(run, "query long, doc long, score long")


def nearest(cells: Cells, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query, doc, score, rank): the best k by cosine (in millionths, over 0) in the nearest cells of each query. queries:
    (query, vector). More probes find more."""
    if not len(cells.centres):
        return queries.sparkSession.createDataFrame([], "query long, doc long, score long, rank int")
    own = unit_queries(cells, queries)
    return top_k(_scored(cells, asked_cells(cells, own, probes or cells.probes), k), ["query"], [F.desc("score"), F.asc("doc")], k)


def unit_queries(cells: Cells, queries: DataFrame) -> DataFrame:
    """Queries of the cells' length and with a direction; others are near to nothing."""
    fit = (F.size("vector") == cells.centres.shape[1]) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")))
    return queries.filter(fit).select(F.col("query").cast("long").alias("query"), V.normalised(F.col("vector")).alias("v")).filter(F.exists("v", lambda x: x != 0))


def exact_nearest(cells: Cells, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The best k among all vectors: the nearest cells give a k-th score, and every cell that can reach it is asked."""
    if not len(cells.centres):
        return nearest(cells, queries, k)
    own = unit_queries(cells, queries)
    found = nearest(cells, queries, k, probes or max(1, len(cells.centres) // 16)).filter(F.col("rank") == k)
    least = found.select("query", ((F.col("score") - 0.5) / 1_000_000).alias("least"))
    again = own.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
    return top_k(_scored(cells, asked_cells(cells, again, 0), k), ["query"], [F.desc("score"), F.asc("doc")], k)


def means(vectors: DataFrame, path: str = "path", vector: str = "vector") -> DataFrame:
    """(path, vector): the element-wise mean of each path's vectors, a sum for each place, so that a path of many vectors is
    combined before it is sent."""
    dim = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    sums = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"x{i}") for i in range(max(0, dim))]
    per = vectors.filter(F.size(vector) > 0).groupBy(path).agg(F.max(F.size(vector)).alias("n"), *sums)
    return per.select(path, F.slice(F.array(*(F.col(f"x{i}") for i in range(max(0, dim)))).cast("array<double>"), F.lit(1), F.col("n")).alias("vector"))


#: Vectors of a block, of which pairs of blocks are compared: at most (each vector is sent once for each block), and at least.
BLOCK, LEAST_BLOCK, BLOCKS = 16_384, 512, 8
#: From this share of cells that a vector would be sent to on, cells part too little, and one cell takes all.
VISITS = 0.25


def representatives(vectors: DataFrame) -> DataFrame:
    """(doc, rep): equal vectors are represented by the smallest id that has them."""
    per = vectors.groupBy("vector").agg(F.min("doc").alias("rep"), F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc), 64) as int))")).alias("salts"))
    here = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda s: F.getbit(F.col("salts"), s) == 1))
    spread = per.withColumn("salt", here).select("vector", "rep", "salt")
    return vectors.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(64)).cast("int")).join(spread, ["vector", "salt"]).select("doc", "rep")


def guest_cells(dots: np.ndarray, radii: np.ndarray, gaps: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each vector, and which cells it is sent to. dots: products with the centres."""
    every = np.arange(dots.shape[1])
    cell = np.argmax(dots, axis=1)
    own = dots[np.arange(len(cell)), cell]
    part = np.arcsin(np.clip((own[:, None] - dots) / np.maximum(gaps[cell], 1e-12), -1, 1))
    sent = (part <= limit) & (np.arccos(np.clip(dots, -1, 1)) <= radii[None, :] + limit) & (every[None, :] < cell[:, None])
    sent[np.arange(len(cell)), cell] = True
    return cell, sent


def visited(sample: np.ndarray, middle: np.ndarray, limit: float) -> float:
    """The share of the cells that a vector of the sample meets: its own, those that it is sent to, and as many that send to it."""
    dots = sample[:2000] @ middle.T
    radii = np.full(len(middle), -10.0)
    np.maximum.at(radii, np.argmax(dots, axis=1), np.arccos(np.clip(dots.max(axis=1), -1, 1)))
    gaps = np.linalg.norm(middle[:, None, :] - middle[None, :, :], axis=2)
    return 2 * float(guest_cells(dots, radii, gaps, limit)[1].mean()) - 1 / len(middle)


def classes(vectors: DataFrame) -> DataFrame:
    """(vector, rep, n, salt, docs): equal vectors, the smallest of their n ids and all of these, in up to 64 rows a vector."""
    salted = vectors.filter("doc IS NOT NULL AND vector IS NOT NULL").select("vector", F.col("doc").cast("long").alias("doc"), F.pmod(F.xxhash64("doc"), F.lit(64)).cast("int").alias("salt"))
    some = salted.groupBy("vector", "salt").agg(F.sort_array(F.collect_set("doc")).alias("docs"))
    same = Window.partitionBy("vector")
    return some.select("vector", F.min(F.get("docs", F.lit(0))).over(same).alias("rep"), F.sum(F.size("docs")).over(same).alias("n"), "salt", "docs")


def said_for_all(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of representatives for all that they stand for, and the pairs within a class. pairs: (doc_a, doc_b, score), with a
    row (rep, rep) for each class; members: (rep, salt, docs) of classes of two and more. The lists of a pair of classes meet in up to 64 * 64
    rows, which are dealt to all tasks before ids are paired."""
    each = lambda end: members.select(F.col("rep").alias(f"doc_{end}"), F.col("salt").alias(f"salt_{end}"), F.col("docs").alias(f"docs_{end}"))
    met = pairs.join(each("a"), "doc_a", "left").join(each("b"), "doc_b", "left").filter("doc_a <> doc_b OR salt_a <= salt_b")
    dealt = met.repartition(max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "doc_a", "salt_a", "doc_b", "salt_b")
    apart = (F.col("doc_a") != F.col("doc_b")) | (F.col("salt_a") != F.col("salt_b"))
    alone = lambda end: F.explode(F.coalesce(f"docs_{end}", F.array(f"doc_{end}")))
    paired = dealt.select("docs_b", "doc_b", "score", apart.alias("apart"), alone("a").alias("x")).select("x", "score", "apart", alone("b").alias("y"))
    return paired.filter("apart OR x < y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "score")


def near_pairs(vectors: DataFrame, threshold: float, centres: int | None = None, block: int | None = None, every: bool = False) -> DataFrame:
    """(doc_a, doc_b, score): pairs of representatives of (doc, vector), doc_a < doc_b, of cosine (in millionths) over the
    threshold, whatever their scope. With `every`, all pairs: also those of equal vectors, and those of vectors of any length, where
    elements that are missing or null count as 0."""
    spark = vectors.sparkSession
    schema = "doc_a long, doc_b long, score long"
    if every:
        same = cut(classes(vectors))
        rows, dim = units(padded(same.filter("docs[0] = rep").withColumnRenamed("rep", "doc")), "doc")
    else:
        rows, dim = units(cut(vectors.groupBy("vector").agg(F.min(F.col("doc").cast("long")).alias("doc"))), "doc")
    rows = cut(rows)  # read by several jobs
    total = rows.count()
    if total < 2 - every:
        return spark.createDataFrame([], schema)
    block = block or min(BLOCK, max(LEAST_BLOCK, -(-total // BLOCKS)))
    sample = sampled(rows, "doc", total, SAMPLE)
    limit = math.acos(max(-1.0, (int(threshold * 1_000_000) - 0.5) / 1_000_000)) + SLACK  # scores are rounded
    middle = fitted(sample, centres or max(1, min(CENTRES, total // 1000, len(sample))))
    if not centres and len(middle) > 1 and visited(sample, middle, limit) >= VISITS:
        middle = fitted(sample, 1)

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                dots = _matrix(batch.column(1), dim) @ middle.T
                cell = np.argmax(dots, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.arccos(np.clip(dots.max(axis=1), -1, 1)))], names=["cell", "angle"])

    stats = {r.cell: r for r in rows.mapInArrow(home, "cell int, angle double").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    radii = np.array([stats[i].radius if i in stats else -10.0 for i in range(len(middle))])
    gaps = np.linalg.norm(middle[:, None, :] - middle[None, :, :], axis=2)

    def guests(batches):
        for batch in batches:
            if batch.num_rows:
                cell, sent = guest_cells(_matrix(batch.column(1), dim) @ middle.T, radii, gaps, limit)
                row, to = np.nonzero(sent)
                took = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(to == cell[row]), took.column(0), took.column(1)], names=["cell", "own", "doc", "v"])

    met = rows.select("doc", "v").mapInArrow(guests, "cell int, own boolean, doc long, v array<double>")
    visits = {r.cell: r.n for r in met.filter("NOT own").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    n = F.element_at(F.lit([max(1, -(-(stats[i].n if i in stats else 0) // block)) for i in range(len(middle))]), F.col("cell") + 1)
    n_guests = F.element_at(F.lit([-(-visits.get(i, 0) // block) for i in range(len(middle))]), F.col("cell") + 1)
    mine = F.pmod(F.xxhash64("doc"), F.when(F.col("own"), n).otherwise(n_guests)).cast("int")
    # own rows meet own rows in the upper triangle of blocks, and every block of own rows meets every block of guests
    each = lambda size, f: F.transform(F.slice(F.sequence(F.lit(0), F.greatest(size, F.lit(1))), 1, size), f)
    place = lambda i, j, guests: F.struct(i.alias("i"), j.alias("j"), F.lit(guests).alias("guests"))
    own = F.concat(each(n, lambda j: place(F.least("mine", j), F.greatest("mine", j), False)), each(n_guests, lambda j: place(F.col("mine"), j, True)))
    at = F.when(F.col("own"), own).otherwise(each(n, lambda i: place(i, F.col("mine"), True)))
    dealt = met.withColumn("mine", mine).withColumn("at", F.explode(at)).select("cell", "own", "doc", "v", "mine", "at.*")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        (_, i, j, with_guests), docs = (k.as_py() for k in key), table["doc"].to_numpy()
        own, at, v = table["own"].to_numpy(), table["mine"].to_numpy(), _matrix(table["v"].combine_chunks(), dim)
        a, b = (np.flatnonzero(own), np.flatnonzero(~own)) if with_guests else (np.flatnonzero(at == i), np.flatnonzero(at == j))
        x, y, score = close(v[a], v[b], threshold)
        low, high = docs[a][x], docs[b][y]
        once = (low < high) | (i != j or with_guests)
        low, high, score = low[once], high[once], score[once]
        return pa.table({"doc_a": pa.array(np.minimum(low, high)), "doc_b": pa.array(np.maximum(low, high)), "score": pa.array(score)})

    found = dealt.groupBy("cell", "i", "j", "guests").applyInArrow(compare, schema)
    if not every or (copies := same.filter("n > 1")).isEmpty():
        return found
    members = cut(copies.join(rows.select(F.col("doc").alias("rep")), "rep", "left_semi").select("rep", "salt", "docs"))
    own = members.select(F.col("rep").alias("doc_a"), F.col("rep").alias("doc_b"), F.lit(1_000_000).cast("long").alias("score")).distinct()
    return said_for_all(found.unionByName(own), members)
