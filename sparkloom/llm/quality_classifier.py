"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping labellers vote junk or toxic for a document, or abstain: heuristics over whole texts that look for one
kind of fault each, and a list of words learned from half of the annotated rows. Expectation-maximisation over the
counts of vote patterns (counted over all documents) estimates how each labeller votes given the class (clean, junk or
toxic), in the manner of Dawid and Skene: abstaining is a vote too, the start is each document's share of votes, and no
heuristic is given an accuracy beforehand. A table of labels is one more labeller, whose accuracy is estimated with the others'
(its silence says nothing, and it errs on at most ERRS of a class: what heuristics miss would else be taken for its errors).
The posteriors of all votes on the rows of a bounded sample then train a linear scorer with two outputs, junk and toxic, on hashed
words, hashed word beginnings of 3 to 8 bytes, and the heuristic votes. A feature counts once a text, and only where its log odds in the sample stand
out from chance by SURE standard errors, so that rare ones do not add noise. The scorer reads texts alone and decides at
every length: a document is kept when both its probabilities are under 0.5. The scorer is a table of fixed size, so
scoring moves no text; equal texts get equal verdicts.

SAMPLE bounds the rows that the scorer is fitted on: every annotated row up to it (beyond, by a hash of the id
and text), and other rows that fill it, a quarter of it at least. An annotated row weighs one, another on which some labeller votes
VOTED, or one where none is annotated. Those on which all are silent have no weak label, as usual; they weigh together as WEAK rows, or as many as clean rows are fewer than
faults, which is what speaks for clean where there are few annotations or none. Everything else covers all rows.

Defined cases: a null or empty text, or one without words, has nothing to score and is rejected; rows that repeat
a doc_id share its annotation (the harshest where labels disagree); a null doc_id has none; without
labels, or with an empty table, the heuristics alone decide; other columns pass through `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X
from sparkloom.llm import text as T
from sparkloom.llm.quality_rules import measure

SAMPLE = 8000
#: Rows that all rows without any vote weigh as in the scorer's sample at least: heuristics are silent on much that
#: annotators see, and silence must not outvote them.
WEAK = 1
#: Share of a class's annotations that may be each of the other classes, at most.
ERRS = 0.0005
#: What rows without annotation weigh to annotated ones: in the estimate, all of them together, and in the scorer's sample, each
#: on which a heuristic votes. Heuristics that find the same fault are no independent witnesses of it.
LIGHT, VOTED = 0.05, 0.3
#: Annotated rows from which LIGHT holds; other rows make up for fewer.
FEW = 100
DIM_BITS = 18
DIM = 1 << DIM_BITS
#: Bytes of the word beginnings that are features.
STEMS = (3, 4, 5, 6, 7, 8)
#: Standard errors by which a feature's log odds must differ from zero; a word's, to be listed.
SURE, LISTED = 4.5, 5.0
#: Words of the learned list at most.
LIST_WORDS = 512
DESCENTS = 150
STEP = 0.05
PENALTY = 1e-4
ROUNDS = 200

ABSTAIN, CLEAN, JUNK, TOXIC = range(4)
FAULTS = ["length", "symbols", "capitals", "repeats", "marks", "echo"]
HEURISTICS = [*FAULTS, "list"]


def votes(data: np.ndarray, offs: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """One row of votes a document, in the order of HEURISTICS. `listed`: ascending hashes of the learned words."""
    m = measure(data, offs)
    n = np.maximum(m["n_words"], 1)
    low = T.LOWER[data]
    s, e, before = T.words(low, offs)
    h = T.span_hash(T.prefix_hash(low), s, e)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[before[:-1][before[:-1] < len(h)]] = False
    bad = [
        m["n_words"] < 3,
        m["n_symbols"] > 0.1 * n,
        m["n_upper"] > 0.4 * np.maximum(m["word_chars"], 1),
        100 * m["n_repeat_words"] > 30 * n,
        m["n_marks"] > 0.2 * n,
        T.sums_by(again, before) > 0.15 * n,
    ]
    hit = np.zeros(len(h), bool)
    if len(listed):
        hit = listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h
    return np.stack([*(np.where(b, JUNK, ABSTAIN) for b in bad), np.where(T.sums_by(hit, before) > 0, TOXIC, ABSTAIN)], axis=1)


def code(rows: np.ndarray) -> np.ndarray:
    return rows @ (4 ** np.arange(rows.shape[1]))


def decode(codes: np.ndarray, m: int) -> np.ndarray:
    return codes[:, None] // 4 ** np.arange(m) % 4


def weak_labels(patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray | None = None, partial: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Class priors (clean, junk, toxic) and (labeller, class, vote) probabilities by expectation-maximisation.

    `gold` has the annotator's votes (ABSTAIN: none): one more labeller, the last of those returned, that errs on ERRS of a
    class at most and is `partial`. The start gives a pattern the share of its votes, and a clean one half a vote, so that
    where nobody votes it is clean, and an annotated one its annotation; a class that nobody votes for is empty. Votes
    are smoothed by one row in all for each labeller and class. That a labeller abstains has a probability too, but for
    `partial` ones, for which it says nothing (1)."""
    if gold is not None:
        patterns, partial = np.column_stack((patterns, gold)), (*partial, patterns.shape[1])
    onehot = (patterns[:, :, None] == np.arange(4)).astype(float)
    weight = onehot[:, :, 1:].sum(1) + [0.5, 0, 0]
    weight /= weight.sum(1, keepdims=True)
    if gold is not None:
        weight = np.where((gold == ABSTAIN)[:, None], weight, gold[:, None] == np.arange(1, 4))
    onehot[:, partial, ABSTAIN] = 0
    prior = None
    for _ in range(ROUNDS):
        own = weight * counts[:, None]
        share = own.sum(0)
        theta = np.einsum("pc,pmv->mcv", own, onehot) + 0.25
        theta[partial, :, ABSTAIN] = 0
        theta /= theta.sum(2, keepdims=True)
        theta[partial, :, ABSTAIN] = 1
        if gold is not None:
            wrong = np.minimum(theta[-1, :, 1:], ERRS) * (1 - np.eye(3))
            theta[-1, :, 1:] = wrong + np.diag(1 - wrong.sum(1))
        moved = np.inf if prior is None else np.abs(share / share.sum() - prior).max()
        prior = share / share.sum()
        weight = posterior(patterns, prior, theta)
        if moved < 1e-9:
            break
    return prior, theta


def lightened(counts: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Counts of patterns, where annotated rows are most of what the accuracies are estimated from."""
    known = counts[gold != ABSTAIN].sum()
    bare = counts.sum() - known
    most = max(LIGHT * known, FEW - known) if known else bare
    return np.where(gold == ABSTAIN, counts * min(1.0, most / max(1, bare)), counts)


def weights_of(p: np.ndarray, voted: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Weights of the sample's rows. Silent ones make clean rows as many as faults, if they can, and weigh as WEAK rows in
    all at least."""
    silent = ~voted & (mark == ABSTAIN)
    own = np.where(silent, 0.0, np.where((mark != ABSTAIN) | (mark == ABSTAIN).all(), 1.0, VOTED))
    lack = own.sum() - 2 * (own * p[:, CLEAN - 1]).sum()
    return np.where(silent, min(1.0, max(WEAK, lack) / max(1, silent.sum())), own)


def posterior(patterns: np.ndarray, prior: np.ndarray, theta: np.ndarray) -> np.ndarray:
    log = np.log(np.maximum(prior, 1e-300)) + sum(np.log(theta[j][:, patterns[:, j]]).T for j in range(patterns.shape[1]))
    log -= log.max(1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(1, keepdims=True)


def hashed(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) once each, by document: words and their beginnings, of those that are `wanted`."""
    low = T.LOWER[data]
    s, e, before = T.words(low, offs)
    sums, doc = T.prefix_hash(low), T.owner(before)
    found = []
    for k in (0, *STEMS):
        long = e - s > k if k else slice(None)
        a, d = s[long], doc[long]
        f = T.span_hash(sums, a, a + k if k else e)
        f = ((f ^ np.uint64(k * 0x9E3779B1)) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
        if wanted is not None:
            hit = wanted[f]
            f, d = f[hit], d[hit]
        found.append(np.unique(d << DIM_BITS | f))
    key = np.unique(np.concatenate(found))
    return key >> DIM_BITS, key & (DIM - 1)


def dense(rows: np.ndarray) -> np.ndarray:
    """The heuristics' votes as 0/1 features; what the learned list says isn't one, as its words are."""
    return (rows[:, : len(FAULTS)] == JUNK).astype(np.float64)


def contrast(a: np.ndarray, b: np.ndarray, faults: float, others: float) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of features that are in `a` of the faults and `b` of the others, and the root of the likelihood ratio
    against being as frequent in both: in standard errors, how sure it is that they are not."""
    r = np.log((a + 0.5) / (faults + 1)) - np.log((b + 0.5) / (others + 1))
    share, both = faults / max(faults + others, 1e-12), a + b
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    rest = faults + others - both
    g = part(a, both * share) + part(b, both * (1 - share)) + part(faults - a, rest * share) + part(others - b, rest * (1 - share))
    return r, np.sqrt(np.maximum(0.0, 2 * g))


def train(doc: np.ndarray, feature: np.ndarray, x: np.ndarray, target: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Weights of features, votes and the bias by logistic regression over rows of their own weights: adaptive moments
    of the whole sample's gradient, so no order of rows matters. Faults weigh as the root of how rare they are."""
    bad, good = target * own, (1 - target) * own
    r, sure = contrast(np.bincount(feature, bad[doc], DIM), np.bincount(feature, good[doc], DIM), bad.sum(), good.sum())
    value = np.where(sure >= SURE, r, 0.0)
    keep = value[feature] != 0
    doc, feature = doc[keep], feature[keep]
    used, at = np.unique(feature, return_inverse=True)
    val, n, k = value[feature], len(target), len(used)
    share = min(0.9, max(1e-3, bad.sum() / max(own.sum(), 1e-12)))
    weight = own * np.where(target >= 0.5, np.sqrt(max(1.0, (1 - share) / share)), 1.0)
    weight = weight / max(weight.sum(), 1e-12)
    w, first, second = (np.zeros(k + x.shape[1] + 1) for _ in range(3))
    decay = np.append(np.full(len(w) - 1, PENALTY), 0.0)
    for i in range(1, DESCENTS + 1):
        z = w[-1] + np.bincount(doc, w[at] * val, n) + x @ w[k:-1]
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        step = np.concatenate((np.bincount(at, err[doc] * val, k), x.T @ err, [err.sum()])) + decay * w
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step * step
        w -= STEP * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    out = np.zeros(DIM + x.shape[1] + 1)
    out[used], out[DIM:] = w[:k] * value[used], w[k:]
    return out


class Model:
    """What fit() learns: priors, vote probabilities, the learned words, and the scorer's weights by output."""

    def __init__(self, prior: np.ndarray, theta: np.ndarray, listed: np.ndarray, weights: np.ndarray):
        self.prior, self.theta, self.listed, self.weights = prior, theta, listed, weights
        self.wanted = (weights[:, :DIM] != 0).any(0)


def listed_words(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Hashes of the words that stand out in annotated toxic rows, those by the most standard errors first."""
    keys, docs, n = [], [], 0
    for d, o in texts:
        low = T.LOWER[d]
        s, e, before = T.words(low, o)
        h, own = T.span_hash(T.prefix_hash(low), s, e), T.owner(before) + n
        once = np.unique(T.mix(h + own.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), return_index=True)[1]
        keys.append(h[once])
        docs.append(own[once])
        n += len(o) - 1
    if not n:
        return np.zeros(0, np.uint64)
    h, at = np.unique(np.concatenate(keys), return_inverse=True)
    bad = toxic[np.concatenate(docs)]
    r, sure = contrast(np.bincount(at, bad, len(h)), np.bincount(at, ~bad, len(h)), float(toxic.sum()), float((~toxic).sum()))
    best = np.flatnonzero((sure >= LISTED) & (r > 0))
    return np.sort(h[best[np.argsort(-sure[best], kind="stable")][:LIST_WORDS]])


def sampled(plain: DataFrame, marks: DataFrame | None, sample: int) -> DataFrame:
    """(annotator, text, at) of the rows that words and scorer are learned from, written."""
    spark = plain.sparkSession
    total = plain.count()
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    part = lambda share: plain.filter(at < int(min(1.0, share) * (1 << 20)))
    if marks is None:
        picked = part(sample / max(1, total)).withColumn("annotator", F.lit(ABSTAIN))
    else:
        known = X.written(marks.filter(F.col("annotator") > 0).join(plain.select("doc_id"), "doc_id"), "annotated")  # a row for each document
        labelled = known.count()
        known = known.distinct()
        if labelled <= sample:  # so few that no text needs to move to meet them
            known = F.broadcast(known)
        picked = part(sample / max(1, labelled)).join(known, "doc_id")
        bare = max(sample - labelled, sample // 4)  # rows that only heuristics know
        if labelled < total:
            fill = part(bare / (total - labelled))
            picked = picked.unionByName(fill.join(known, "doc_id", "left_anti").withColumn("annotator", F.lit(ABSTAIN)))
    return X.written(picked.select(F.col("annotator").cast("int").alias("annotator"), "text", F.xxhash64("doc_id", "text").alias("at")), "sample")


def fit(docs: DataFrame, labels: DataFrame | None, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marks = None
    if labels is not None:
        kind = F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, JUNK).when(F.col("quality") == 1, CLEAN).otherwise(ABSTAIN)
        marks = labels.select(F.col(key).cast("long").alias("doc_id"), kind.alias("annotator")).groupBy("doc_id").agg(F.max("annotator").alias("annotator"))
    picked = sampled(plain, marks, sample)
    # the sample is bounded, so one task can hold it; sorted, so that it learns the same each time
    one_task = lambda f, schema: picked.repartition(1).sortWithinPartitions("at", "annotator").mapInArrow(X.trimmed(f), schema).collect()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            mark = batch.column(0).to_numpy()
            half = pa.array((mark != ABSTAIN) & (batch.column(2).to_numpy() >> 20 & 1 == 0))
            part = batch.filter(half)
            data, offs = T.column(part.column(1))
            texts += [(d, o) for _, _, d, o in T.chunks(data, offs)]
            toxic.append(part.column(0).to_numpy() == TOXIC)
        if toxic:
            yield pa.RecordBatch.from_arrays([pa.array([listed_words(texts, np.concatenate(toxic)).tobytes()], pa.binary())], names=["words"])

    got = one_task(words, "words binary")
    listed = np.frombuffer(got[0].words, np.uint64) if got else np.zeros(0, np.uint64)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = T.column(batch.column(1))
            for a, z, d, o in T.chunks(data, offs):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array(code(votes(d, o, listed)))], names=["doc_id", "code"])

    marked = plain.mapInArrow(X.trimmed(vote), "doc_id long, code long")
    marked = marked.withColumn("annotator", F.lit(ABSTAIN)) if marks is None else marked.join(marks, "doc_id", "left").withColumn("annotator", F.coalesce("annotator", F.lit(ABSTAIN)))
    full = (F.col("annotator") + 4 * F.col("code")).cast("long")
    counted = marked.groupBy(full.alias("pattern")).agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 4 * 2 ** 7 patterns at most
    patterns = decode(np.array([r["pattern"] for r in counted] or [0], np.int64), 1 + len(HEURISTICS))
    counts = lightened(np.array([r["n"] for r in counted] or [1], np.float64), patterns[:, 0])
    prior, theta = weak_labels(patterns[:, 1:], counts, patterns[:, 0])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, feature, seen, marks_, n = [], [], [], [], 0
        for batch in batches:
            data, offs = T.column(batch.column(1))
            marks_.append(batch.column(0).to_numpy())
            for _, _, d, o in T.chunks(data, offs):
                i, f = hashed(d, o)
                doc.append(i + n)
                feature.append(f.astype(np.int32))
                seen.append(votes(d, o, listed))
                n += len(o) - 1
        if not n:
            return
        v, mark = np.concatenate(seen), np.concatenate(marks_)
        p = posterior(np.column_stack((v, mark)), prior, theta)
        weight = weights_of(p, (v != ABSTAIN).any(1), mark)
        doc_, feature_ = np.concatenate(doc), np.concatenate(feature)
        # junk is told from clean documents: toxic ones may be either
        heads = [train(doc_, feature_, dense(v), p[:, JUNK - 1], weight * (1 - p[:, TOXIC - 1])), train(doc_, feature_, dense(v), p[:, TOXIC - 1], weight)]
        yield pa.RecordBatch.from_arrays([pa.array([np.stack(heads).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    got = one_task(learn, "weights binary")
    weights = np.frombuffer(got[0].weights, "<f4").astype(np.float64) if got else np.zeros(2 * (DIM + len(FAULTS) + 1))
    X.dropped(picked)
    return Model(prior, theta, listed, weights.reshape(2, -1))


SCORES = "doc_id long, junk_posterior double, toxic_posterior double, score double, kept boolean"


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """SCORES of every row: the weak-label posterior of its heuristic votes, the scorer's larger probability, and the
    verdict."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            data, offs = T.column(batch.column(1))
            for a, z, d, o in T.chunks(data, offs):
                v = votes(d, o, m.listed)
                post = posterior(v, m.prior, m.theta)
                p = probability(m, d, o, v)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array(post[:, JUNK - 1]), pa.array(post[:, TOXIC - 1]), pa.array(p), pa.array(p < 0.5)], names=["doc_id", "junk_posterior", "toxic_posterior", "score", "kept"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(X.trimmed(run), SCORES)


def logits(model: Model, data: np.ndarray, offs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The scorer's log odds, a row an output."""
    doc, feature = hashed(data, offs, model.wanted)
    x = dense(own)
    return np.stack([w[-1] + np.bincount(doc, w[feature], len(own)) + x @ w[DIM:-1] for w in model.weights])


def probability(model: Model, data: np.ndarray, offs: np.ndarray, own: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(logits(model, data, offs, own).max(0), -30, 30)))
    empty = np.diff(T.words(data, offs)[2]) == 0
    return np.where(empty, 1.0, p)


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the scorer keeps, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    put = docs.select("*", F.col(text).cast("string").alias(X.unused(docs, "scored")))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            data, offs = T.column(batch.column(batch.num_columns - 1))
            keep = [probability(m, d, o, votes(d, o, m.listed)) < 0.5 for _, _, d, o in T.chunks(data, offs)]
            if keep:
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(np.concatenate(keep)))

    return put.mapInArrow(X.trimmed(good), docs.schema)
