"""Quality rules: text statistics, hard base rules, and robust multivariate outliers.

Statistics are taken over whole texts. For each (language, source) the minimum covariance determinant is sought:
of all halves of the good documents (floor((n + p + 1) / 2) of them) the one whose covariance has the least
determinant. Four deterministic starts (spreads alone, and the covariances of winsorised, of squashed and of
unit-length deviations from the medians) take two concentration steps each: the half that lies nearest by
Mahalanobis distance gives the next mean and covariance, and the determinant never grows. The start with the least
determinant then goes on until its determinant stays. A document is rejected when its distance exceeds a chi-square
quantile.

A step is two map-side combined aggregations whatever the size of a group: counts by distance bin find the half, and
moments are summed inside it (the last bin by the share that is still needed). Medians and quartiles come from counts
by rounded value, so nothing depends on how rows are partitioned.

Each group's estimate is drawn to its language's as PRIOR documents would, and that to the estimate over all: a group of
a few documents has nearly its parent's, a large one its own, without a size at which this changes.

Defined cases: null text has no words and fails the base rules; null language or source is a group of
its own; a group without good documents has no estimate and needs none; equal documents get equal verdicts within a
group; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X
from sparkloom.llm import text as T

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Documents that a group's parent weighs as in the group's estimate.
PRIOR = 32.0
FIRST_STEPS = 2
#: Further steps at most; they end when no group's determinant falls by more than this share.
STEPS = 30
SETTLED = 1e-3
TAIL = 1e-6
BINS_PER_OCTAVE = 64
#: Medians and quartiles are of values rounded to so many parts of one.
GRAIN = 10_000

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_lines long"
#: Transformed statistics and the least standard deviation each is given, so that a statistic which
#: hardly varies in clean text does not reject on noise.
TRANSFORMED = {
    "x_length": (lambda: F.log1p("n_words"), 1.0),
    "x_word": (lambda: F.log(F.col("word_chars") / F.greatest("n_words", F.lit(1)) + 1), 0.08),
    "x_symbol": (lambda: F.sqrt(F.col("n_symbols") / F.greatest("n_words", F.lit(1))), 0.06),
    "x_upper": (lambda: F.sqrt(F.col("n_upper") / F.greatest("word_chars", F.lit(1))), 0.06),
    "x_mark": (lambda: F.sqrt(F.col("n_marks") / F.greatest("n_words", F.lit(1))), 0.10),
    "x_dup": (lambda: F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), 0.15),
    "x_repeat": (lambda: F.sqrt(F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))), 0.12),
}
NAMES = list(TRANSFORMED)

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_MARK = np.isin(np.arange(256), list(b"!?"))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each document of a chunk."""
    n = len(offs) - 1
    s, e, before = T.words(data, offs)
    doc = T.owner(before)
    out = {"n_words": np.diff(before)}
    for name, hit in (("word_chars", _FIRST[data] & ~T.SPACE[data]), ("n_symbols", _SYMBOL[data]), ("n_upper", _UPPER[data]), ("n_marks", _MARK[data])):
        out[name] = T.sums_by(hit, offs)
    sums = T.prefix_hash(data)

    ls, le = T.runs(data != 10, offs)  # an empty line has no word, so only runs of other bytes matter
    with_word = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[with_word], le[with_word]
    line_doc = np.searchsorted(offs, ls, "right") - 1
    key = T.mix(T.span_hash(sums, ls, le) + line_doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    first = np.unique(key, return_index=True)[1]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=n)

    windows = T.window_hash(T.span_hash(sums, s, e), WINDOW_WORDS)
    whole = doc[: len(windows)] == doc[WINDOW_WORDS - 1 :]
    at = np.flatnonzero(whole)
    key = T.mix(windows[at] + doc[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW_WORDS, -1)
    out["n_repeat_words"] = T.sums_by(np.cumsum(edge)[: len(s)] > 0, before)
    return out


def statistics(docs: DataFrame, extra: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """STATS of every document, with the columns `extra` beside them."""
    names = [x.split(" ")[0] for x in STATS.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = T.column(batch.column(1))
            for a, b, d, o in T.chunks(data, offs):
                got = measure(d, o)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(got[x].astype(np.int64)) for x in names), *(batch.column(2 + i)[a:b] for i in range(len(extra)))], names=["doc_id", *names, *extra])

    schema = STATS + "".join(f", {x} string" for x in extra)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(x).cast("string").alias(x) for x in extra)).mapInArrow(X.trimmed(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def chi_square_quantile(p: int, tail: float) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - tail)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def _chi_cdf(p: int, x: float) -> float:
    from statistics import NormalDist

    return NormalDist().cdf(((x / p) ** (1 / 3) - (1 - 2 / (9 * p))) / math.sqrt(2 / (9 * p)))


def consistency(p: int, share: float) -> float:
    """What the covariance of the nearest share of a normal sample falls short by."""
    return 1.0 if share >= 1 else share / max(1e-3, _chi_cdf(p + 2, chi_square_quantile(p, 1 - share)))


P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FLOORS = np.array([TRANSFORMED[x][1] for x in NAMES])
ESTIMATE = "group long, start int, n double, center array<double>, cov array<double>, inverse array<double>, logdet double"


def distance(x: str = "x", center: str = "center", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance, from array columns."""
    d = [F.col(x)[i] - F.col(center)[i] for i in range(P)]
    out = F.lit(0.0)
    for i, j in PAIRS:
        out = out + (1.0 if i == j else 2.0) * d[i] * d[j] * F.col(inverse)[i * P + j]
    return F.greatest(out, F.lit(0.0))


def moments(x: str, weight: Column) -> list[Column]:
    """One array: weight, weighted sums and products."""
    v = [F.col(x)[i] for i in range(P)]
    return [F.array(F.sum(weight), *(F.sum(weight * v[i]) for i in range(P)), *(F.sum(weight * v[i] * v[j]) for i, j in PAIRS)).alias("m")]


def solved(m: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centers, covariances (no spread under its floor), inverses and log determinants of rows of moments."""
    w = np.maximum(m[:, :1], 1e-12)
    center = m[:, 1 : 1 + P] / w
    cov = np.zeros((len(m), P, P))
    for k, (i, j) in enumerate(PAIRS):
        cov[:, i, j] = cov[:, j, i] = m[:, 1 + P + k] / w[:, 0] - center[:, i] * center[:, j]
    cov *= np.array([consistency(P, s) for s in share])[:, None, None]
    own = np.einsum("kii->ki", cov)
    own += np.maximum(0.0, FLOORS**2 - own)
    return center, cov, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def estimates(rows: DataFrame, name: str) -> DataFrame:
    """ESTIMATE of rows of group, start, n (documents of the group) and moments m, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy()
            m = np.array(batch.column(3).to_pylist(), float).reshape(len(n), -1)
            center, cov, inverse, logdet = solved(m, m[:, 0] / n)
            rows_ = lambda a: pa.array(a.reshape(len(n), -1).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), rows_(center), rows_(cov), rows_(inverse), pa.array(logdet)], names=[x.split(" ")[0] for x in ESTIMATE.split(", ")])

    return X.written(rows.select("group", F.col("start").cast("int"), F.col("n").cast("double"), "m").mapInArrow(X.trimmed(run), ESTIMATE), name)


def concentrated(points: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step: the moments of each estimate's nearest half, solved."""
    binned = points.join(now.select("group", "start", "n", "center", "inverse"), "group").withColumn("bin", F.floor(F.log2(distance() + 1e-9) * BINS_PER_OCTAVE).cast("int"))
    counts = binned.groupBy("group", "start", "bin").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    half = F.floor((F.col("n") + P + 1) / 2)
    half = F.least(half, F.col("n"))
    upto = F.sum("k").over(Window.partitionBy("group", "start").orderBy("bin"))  # at most a few thousand bins each
    edge = counts.withColumn("upto", upto).filter((F.col("upto") >= half) & (F.col("upto") - F.col("k") < half))
    edge = edge.select("group", "start", F.col("bin").alias("last"), ((half - (F.col("upto") - F.col("k"))) / F.col("k")).alias("part"))
    reach = X.written(now.select("group", "start", "n", "center", "inverse").join(edge, ["group", "start"]), "mcd_reach")
    placed = points.join(reach, "group").withColumn("bin", F.floor(F.log2(distance() + 1e-9) * BINS_PER_OCTAVE).cast("int")).filter("bin <= last")
    weight = F.when(F.col("bin") < F.col("last"), F.lit(1.0)).otherwise(F.col("part"))
    out = estimates(placed.groupBy("group", "start").agg(F.first("n").alias("n"), *moments("x", weight)).select("group", "start", "n", "m"), "mcd")
    X.dropped(reach)
    return out


def first_estimates(points: DataFrame) -> DataFrame:
    """The four starts of each group, from exact medians and quartiles of rounded values."""
    long = points.select("group", F.posexplode("x").alias("i", "v")).groupBy("group", "i", F.round(F.col("v") * GRAIN).cast("long").alias("v")).agg(F.count("*").alias("k"))
    by = Window.partitionBy("group", "i").orderBy("v")
    ranked = long.withColumn("upto", F.sum("k").over(by)).withColumn("n", F.sum("k").over(Window.partitionBy("group", "i")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("v"))) / float(GRAIN)
    quart = ranked.groupBy("group", "i").agg(F.max("n").alias("n"), at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"))
    floor = F.element_at(F.array(*(F.lit(float(f)) for f in FLOORS)), F.col("i") + 1)
    one = quart.select("group", "n", "i", "b", F.greatest((F.col("c") - F.col("a")) / 1.349, floor).alias("s"))
    pick = lambda c: F.array(*(F.max(F.when(F.col("i") == i, F.col(c))) for i in range(P))).alias(c)
    unit = X.written(one.groupBy("group").agg(F.max("n").alias("n"), pick("b"), pick("s")), "mcd_units")
    z = [(F.col("x")[i] - F.col("b")[i]) / F.col("s")[i] for i in range(P)]
    norm = F.greatest(F.sqrt(sum((v * v for v in z), F.lit(0.0))), F.lit(1e-9))
    bent = [F.array(*(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), v)) for v in z)), F.array(*(F.tanh(v) for v in z)), F.array(*(v / norm * float(np.sqrt(P)) for v in z))]
    shapes = points.join(unit, "group").select("group", "n", "b", "s", F.posexplode(F.array(*bent)).alias("start", "y"))
    got = shapes.groupBy("group", "start").agg(F.first("n").alias("n"), F.first("b").alias("b"), F.first("s").alias("s"), *moments("y", F.lit(1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                m, s = np.array(r["m"]), np.array(r["s"])
                w = m[0]
                cov = np.zeros((P, P))
                for k, (i, j) in enumerate(PAIRS):
                    cov[i, j] = cov[j, i] = m[1 + P + k] / w  # about the median
                d = np.sqrt(np.maximum(np.diag(cov), 1e-6))
                cor = 0.999 * cov / np.outer(d, d) + 0.001 * np.eye(P)
                np.fill_diagonal(cor, 1.0)
                for start, c in ((r["start"] + 1, cor), *([(0, np.eye(P))] if r["start"] == 0 else [])):
                    full = c * np.outer(s, s)
                    out.append({"group": r["group"], "start": start, "n": float(r["n"]), "center": r["b"], "cov": full.ravel().tolist(), "inverse": np.linalg.inv(full).ravel().tolist(), "logdet": float(np.linalg.slogdet(full)[1])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("group", pa.int64()), ("start", pa.int32()), ("n", pa.float64()), *((c, pa.list_(pa.float64())) for c in ("center", "cov", "inverse")), ("logdet", pa.float64())]))

    return X.written(got.select("group", "start", "n", "b", "s", "m").mapInArrow(X.trimmed(run), ESTIMATE), "mcd")


def fit(points: DataFrame) -> DataFrame:
    """ESTIMATE of each group of `points` (group long, x array<double>): the minimum covariance determinant.

    Between steps only the estimates move: as many rows as groups (four times as many at first). They are kept as a
    table and joined, so no number of groups has to fit the driver or a broadcast.
    """
    now = first_estimates(points)
    for _ in range(FIRST_STEPS):
        old, now = now, concentrated(points, now)
        X.dropped(old)
    names = ["start", "n", "center", "cov", "inverse", "logdet"]
    least = lambda rows: rows.groupBy("group").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("e")).select("group", "e.*")
    old, now = now, X.written(least(now), "mcd")
    X.dropped(old)
    for _ in range(STEPS):
        after = concentrated(points, now)
        fell = F.col("was") - F.col("logdet")
        moved = after.join(now.select("group", F.col("logdet").alias("was")), "group").agg(F.max(fell).alias("d")).first()["d"]
        if moved is None or moved <= SETTLED:
            break
        X.dropped(now)
        now = after
    # a step that gained nothing, as spreads have a floor, is not taken
    return X.written(least(now.unionByName(after)), "mcd")


def drawn_to(model: DataFrame, cells: DataFrame, levels: int) -> DataFrame:
    """(group, center, inverse) of the finest groups, each drawn to its parent. `cells`: g0, g1, ... of each finest group."""
    out = cells
    for k in range(levels):
        own = model.select(F.col("group").alias(f"g{k}"), F.col("n").alias(f"n{k}"), F.col("center").alias(f"c{k}"), F.col("cov").alias(f"v{k}"))
        out = out.join(own, f"g{k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: np.array(batch.column(batch.schema.names.index(c)).to_pylist(), float).reshape(batch.num_rows, -1)  # noqa: B023, E731
            center, cov = get("c0"), get("v0")
            for k in range(1, levels):
                w = get(f"n{k}") / (get(f"n{k}") + PRIOR)
                center, cov = w * get(f"c{k}") + (1 - w) * center, w * get(f"v{k}") + (1 - w) * cov
            inverse = np.linalg.inv(cov.reshape(-1, P, P)).reshape(len(cov), -1)
            rows = lambda a: pa.array(a.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(f"g{levels - 1}")), rows(center), rows(inverse)], names=["group", "center", "inverse"])

    return X.written(out.mapInArrow(X.trimmed(run), "group long, center array<double>, inverse array<double>"), "mcd")


def outliers(stats: DataFrame, levels: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """`stats` with base_failed, distance2 and kept."""
    name = lambda k: F.xxhash64(F.lit(k), *(F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("null")) for x in levels[:k]))
    depth = len(levels) + 1
    put = stats.withColumn("base_failed", base_failed()).withColumn("x", F.array(*(f().cast("double") for f, _ in TRANSFORMED.values()))).withColumns({f"g{k}": name(k) for k in range(depth)})
    stats = X.written(put, "stats")
    good = stats.filter(~F.col("base_failed"))
    points = good.select("x", F.explode(F.array(*(f"g{k}" for k in range(depth)))).alias("group"))
    cells = good.select(*(f"g{k}" for k in range(depth))).distinct()
    own = drawn_to(fit(points), cells, depth)
    out = stats.join(own.withColumnRenamed("group", f"g{depth - 1}"), f"g{depth - 1}", "left")
    # a document that failed the base rules may be of a group without an estimate
    out = out.withColumn("distance2", F.when(F.col("center").isNotNull(), distance()))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= chi_square_quantile(P, TAIL)))
    return out.drop("center", "inverse", "x", *(f"g{k}" for k in range(depth)))


def quality_rules(docs: DataFrame, levels: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Statistics, base verdict, distance and verdict of every document."""
    return outliers(statistics(docs, list(levels)), levels)
