"""Mixing sources to target weights by soft membership.

A labelled table names a domain for some documents; a classifier of bounded size fitted on a bounded
sample of them gives every document a posterior over the domains. Each document gets a rate (expected
number of copies) by projected-gradient least squares: minimise

    sum over domains of ((expected tokens - target tokens) / total tokens)**2 / 2 + RIDGE * spread / 2

over rates >= floor, where a domain's expected tokens are the sum of rate * tokens * posterior and the
spread is the token-weighted mean of (rate - 1)**2: of all mixes that meet the targets the nearest to the
input. A step takes the gradient at a point ahead of the rates (Nesterov's momentum, begun anew where it turns against
the gradient), moves all rates against it and cuts them at the floor. What a step needs from the whole corpus is as many
numbers as domains, one map-side combined aggregation; a document's rate follows from its posterior and the steps so
far, so rates are never stored or moved. Steps end when no rate would move by more than TOLERANCE; if that isn't
reached in STEPS steps, `solve` raises. A document is then repeated floor(rate + u) times, with u
drawn from a hash of its id and text.

Defined cases: null or empty text has no tokens and rate 1; a null doc_id takes part, unlabelled; rows
that repeat a doc_id share its label; targets need not add up to one; a domain without documents can't
be met and keeps its residual; an empty table gives no rows; other columns pass through `mixed`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X
from sparkloom.llm import text as T

SAMPLE = 6000
DIM_BITS = 16
RIDGE = 1e-4
FLOOR = 0.0
STEPS = 1000
#: The largest move of a rate, relative to the step's length, at which the steps end.
TOLERANCE = 3e-5
DRAW = 1 << 30


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed lower-cased words and two general ones: how far words have symbols and capitals."""
    low = T.LOWER[data]
    s, e, before = T.words(low, offs)
    word = T.span_hash(T.prefix_hash(low), s, e) >> np.uint64(64 - DIM_BITS)
    bare = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122) | (data >= 128))))
    odd = 2 * (bare[e] - bare[s]) < e - s
    return np.where(odd, 1 << DIM_BITS, word.astype(np.int64)), before


DIM = (1 << DIM_BITS) + 1


class Model:
    """Naive Bayes log weights by domain, over mean log counts, with a scale that calibrates them."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, scale: float):
        self.names, self.weights, self.bias, self.scale = names, weights, bias, scale

    def posterior(self, idx: np.ndarray, before: np.ndarray) -> np.ndarray:
        total = np.zeros((len(before) - 1, len(self.names)))
        for k in range(len(self.names)):
            run = np.concatenate(([0.0], np.cumsum(self.weights[idx, k])))
            total[:, k] = run[before[1:]] - run[before[:-1]]
        # words of one text are far from independent: the evidence grows with the root of their number
        z = self.bias + self.scale * total / np.sqrt(np.maximum(np.diff(before), 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, domains: DataFrame, names: list[str], text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """domains: (key, domain). The sample is taken by a hash; its bound is `sample` rows on average."""
    marks = domains.select(F.col(key).cast("long").alias("doc_id"), F.col("domain")).filter(F.col("domain").isin(names) & F.col("doc_id").isNotNull())
    known = marks.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = known.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 20))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).join(known, "doc_id")
    rows = rows.select("domain", "text", F.xxhash64("doc_id", "text").alias("at"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            data, offs = T.column(batch.column(1))
            marks_ = batch.column(0).to_pylist()
            for a, _, d, o in T.chunks(data, offs):
                idx, before = features(d, o)
                held += [(names.index(marks_[a + i]), idx[before[i] : before[i + 1]]) for i in range(len(o) - 1)]
        k = len(names)
        counts = np.full((DIM, k), 0.02)
        docs_ = np.ones(k)
        for i, (c, idx) in enumerate(held):
            if i % 2 == 0:
                np.add.at(counts[:, c], idx, 1 / np.sqrt(max(1, len(idx))))
                docs_[c] += 1
        weights = np.log(counts / counts.sum(0))
        weights -= weights.mean(1, keepdims=True)
        bias = np.log(docs_ / docs_.sum())
        # the other half calibrates the scale: the one with the least log loss
        best, scale = np.inf, 0.1
        rest = [h for i, h in enumerate(held) if i % 2]
        if rest:
            before = np.concatenate(([0], np.cumsum([len(h[1]) for h in rest])))
            idx = np.concatenate([h[1] for h in rest])
            truth = np.array([h[0] for h in rest])
            for s in (0.01, 0.03, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2):
                p = Model(names, weights, bias, s).posterior(idx, before)[np.arange(len(rest)), truth]
                loss = -np.log(np.maximum(p, 1e-12)).mean()
                if loss < best - 1e-9:
                    best, scale = loss, s
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((weights.ravel(), bias, [scale])).astype("<f4").tobytes()], pa.binary())], names=["model"])

    got = rows.repartition(1).sortWithinPartitions("at").mapInArrow(X.trimmed(learn), "model binary").collect()
    if not got:
        return Model(names, np.zeros((DIM, len(names))), np.zeros(len(names)), 0.0)
    flat = np.frombuffer(got[0].model, "<f4").astype(np.float64)
    k = len(names)
    return Model(names, flat[: DIM * k].reshape(DIM, k), flat[DIM * k : -1], float(flat[-1]))


def memberships(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, at, tokens, p0, p1, ...): a hash of id and text, the words, and the posterior."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = T.column(batch.column(2))
            for a, z, d, o in T.chunks(data, offs):
                idx, before = features(d, o)
                p = held.value.posterior(idx, before)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], batch.column(1)[a:z], pa.array(np.diff(before)), *(pa.array(p[:, i]) for i in range(k))], names=["doc_id", "at", "tokens", *(f"p{i}" for i in range(k))])

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")).alias("at"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(X.trimmed(run), "doc_id long, at long, tokens long" + "".join(f", p{i} double" for i in range(k)))


class Steps:
    """The steps so far: of each its length, the momentum before it, and the pull of each domain."""

    def __init__(self, floor: float, ridge: float):
        self.floor, self.ridge, self.taken = floor, ridge, []

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rates of documents with these posteriors: after the last step, before it, and where that step set out."""
        now = old = ahead = np.full(len(p), max(1.0, self.floor))
        for length, momentum, pull in self.taken:
            ahead = now + momentum * (now - old)
            old, now = now, np.maximum(self.floor, ahead - length * (p @ pull + self.ridge * (ahead - 1)))
        return now, old, ahead


class Fit:
    """Steps, the expected tokens by domain, their targets, the total, and how many steps it took."""

    def __init__(self, names, steps, reached, goal, total):
        self.names, self.steps, self.reached, self.goal, self.total = names, steps, reached, goal, total

    @property
    def residual(self) -> float:
        """The largest share of all tokens by which a domain misses its target."""
        return float(np.abs(self.reached - self.goal).max() / self.total) if self.total else 0.0


def sums(rows: DataFrame, k: int, f) -> np.ndarray:
    """The sum over all rows of `f(tokens, posteriors)`, an array of numbers of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                t = batch.column(0).to_numpy().astype(np.float64)
                p = np.stack([batch.column(1 + i).to_numpy() for i in range(k)], axis=1)
                got = f(t, p)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    # in the order of the parts, so that the sum is the same each time
    parts = rows.select("tokens", *(f"p{i}" for i in range(k))).mapInArrow(X.trimmed(run), "s array<double>").collect()  # a row a task
    return np.sum([r["s"] for r in parts], axis=0) if parts else np.zeros(0)


def solve(rows: DataFrame, names: list[str], targets: dict[str, float], floor: float = FLOOR, scale: float = 1.0, ridge: float = RIDGE, steps: int = STEPS) -> Fit:
    """Projected gradient descent on the rates, in the metric of tokens: the gradient of a document's rate is its
    posterior's product with the domains' excess shares, and the ridge's pull to 1. `scale` is the mix's size over the
    input's."""
    k = len(names)
    share = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    share = scale * (share / share.sum() if share.sum() else np.full(k, 1 / k))
    first = sums(rows, k, lambda t, p: np.concatenate(([t.sum()], np.einsum("n,ni,nj->ij", t, p, p).ravel())))
    done = Steps(floor, ridge)
    if not len(first) or not first[0]:
        return Fit(names, done, np.zeros(k), share * 0, 0.0)
    total = first[0]
    # the gradient's Lipschitz constant: the largest curvature over all mixes
    length = 1 / (np.linalg.eigvalsh(first[1:].reshape(k, k) / total).max() + ridge)

    def look(t: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected tokens now and before the last step; how far that step went, and whether it turned back."""
        now, old, ahead = done.rates(p)
        return np.concatenate(((t * now) @ p, (t * old) @ p, [t @ (now - ahead) ** 2, t @ ((ahead - now) * (now - old))]))

    age = 1.0
    for _ in range(steps):
        got = sums(rows, k, look) / total
        now, old = got[:k], got[k : 2 * k]
        if done.taken and got[-2] <= (TOLERANCE * length) ** 2:
            return Fit(names, done, now * total, share * total, total)
        older, age = age, 1.0 if got[-1] > 0 else (1 + np.sqrt(1 + 4 * age**2)) / 2
        momentum = 0.0 if age == 1.0 else (older - 1) / age
        # expected tokens are linear in the rates
        done.taken.append((length, momentum, now + momentum * (now - old) - share))
    raise RuntimeError(f"the rates did not settle in {steps} steps; the last moved them by {np.sqrt(got[-2]):.3g}")


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], text: str = "text", key: str = "doc_id", floor: float = FLOOR, scale: float = 1.0) -> tuple[DataFrame, Fit]:
    """(doc_id, at, tokens, posteriors, rate, copies) of every row, and the fit."""
    names = sorted(targets)
    rows = X.written(memberships(docs, fit(docs, domains, names, text, key), text, key), "members")
    found = solve(rows, names, targets, floor, scale)
    k = len(names)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(3 + i).to_numpy() for i in range(k)], axis=1)
            r = np.where(batch.column(2).to_numpy() == 0, 1.0, found.steps.rates(p)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

    u = F.pmod(F.xxhash64("at"), F.lit(DRAW)) / DRAW
    out = rows.mapInArrow(X.trimmed(rated), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", rate double").withColumn("copies", F.floor(F.col("rate") + u).cast("int"))
    return out, found


def reach(rows: DataFrame, names: list[str], targets: dict[str, float]) -> float:
    """The least size of the mix, over the input's, at which no domain has more tokens than its target."""
    got = sums(rows, len(names), lambda t, p: np.concatenate(([t.sum()], t @ p)))
    if not len(got) or not got[0]:
        return 1.0
    total = sum(max(0.0, targets.get(n, 0.0)) for n in names)
    return max([1.0, *(got[1 + i] / got[0] / (targets[n] / total) for i, n in enumerate(names) if targets.get(n, 0.0) > 0)])


def mixed(docs: DataFrame, domains: DataFrame, targets: dict[str, float], text: str = "text", key: str = "doc_id", floor: float = FLOOR, scale: float | None = 1.0) -> DataFrame:
    """The rows of `docs`, each as often as its rate says. Rates come from the text again, so no text is
    moved to meet its rate. Without a `scale` the mix is as large as it must be for targets to be met by repeating
    alone."""
    names = sorted(targets)
    model = fit(docs, domains, names, text, key)
    rows = X.written(memberships(docs, model, text, key), "members")
    steps = solve(rows, names, targets, floor, reach(rows, names, targets) if scale is None else scale).steps
    X.dropped(rows)
    held = docs.sparkSession.sparkContext.broadcast((model, steps))
    width = len(docs.columns)
    u = F.pmod(F.xxhash64(F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"))), F.lit(DRAW)) / DRAW
    put = docs.select("*", F.col(text).cast("string").alias(X.unused(docs, "text_")), u.alias(X.unused(docs, "draw")))

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_, steps_ = held.value
        for batch in batches:
            data, offs = T.column(batch.column(width))
            draw = batch.column(width + 1).to_numpy()
            for a, z, d, o in T.chunks(data, offs):
                idx, before = features(d, o)
                r = np.where(np.diff(before) == 0, 1.0, steps_.rates(model_.posterior(idx, before))[0])
                times = np.floor(r + draw[a:z]).astype(np.int64)
                part = batch.slice(a, z - a).select(list(range(width)))
                for i in range(0, int(times.max(initial=0))):  # the rows that occur more than i times
                    yield part.filter(pa.array(times > i))

    return put.mapInArrow(X.trimmed(repeat), docs.schema)
