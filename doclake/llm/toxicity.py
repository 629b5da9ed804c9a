"""Toxicity by non-negative positive-unlabelled learning.

A linear model over words and word beginnings is trained with numpy from texts confirmed as toxic and from unlabelled ones.
The risk is the class-prior-corrected estimate: prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]); where the
second part turns negative, its gradient is reversed. The prior is the share of toxic rows among all labelled training rows.
Features that are far more frequent in toxic texts than in all texts are kept (Z_LEAST, RATIO_LEAST). Two numbers, slope
and offset, are then fitted on labelled training rows, so that a score reads as a probability.

Training reads bounded samples, drawn by a hash of the id: at most MAX_POSITIVE toxic texts, MAX_UNLABELLED unlabelled and
MAX_LABELLED labelled ones. The prior is counted over all labels, the frequencies that features are chosen by over all texts
that are not held out, and every text is scored. Of the sample only the features kept come to the driver, as places in its
texts; of the others, numbers of texts. A model has at most 2**BITS weights.

Rows are held out of training where crc32 of the id, as text, leaves 1 modulo 3. NULL texts count as empty. Without any toxic
training row every score is the prior, or 0 without labels. Repeated rows are scored each, rows without an id as well; labels
that repeat an id count as toxic if one of them does; rows of labels without id or value are left out; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import stored

MAX_POSITIVE, MAX_UNLABELLED, MAX_LABELLED = 4000, 10000, 6000
THRESHOLD = 0.7
#: Size of the feature space, and lengths of word beginnings that are features beside the whole word (0).
BITS, BEGINNINGS = 18, (0, 4, 5, 6, 7)
Z_LEAST, RATIO_LEAST, LEAST_TEXTS = 5.0, 2.5, 3
EPOCHS, BATCH, RATE, SHRINK, SEED = 40, 1024, 0.05, 1e-4, 7
#: Characters of text worked on at a time inside a task.
SLICE_CHARS = 4_000_000
# Fixed value: what is cut off at both ends of a word.
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&$|-_/\\+=~`"


@dataclass(frozen=True)
class Model:
    """Active features (sorted), their weights, and the two numbers of the calibration."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and vocabulary number of each word, and the vocabulary."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = pc.list_flatten(lists).dictionary_encode()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return owner, coded.indices.to_numpy(zero_copy_only=False), pc.utf8_trim(coded.dictionary, PUNCTUATION)


def _features(vocabulary: pa.Array) -> np.ndarray:
    """Feature numbers of each word, one column for each of BEGINNINGS; -1 for shorter words."""
    length = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False)
    columns = []
    for n in BEGINNINGS:
        part = vocabulary if n == 0 else pc.utf8_slice_codeunits(vocabulary, 0, n)
        values = np.asarray(part.to_pylist(), dtype=object)
        mixed = pd.util.hash_array(values, categorize=False) * np.uint64(2 * n + 0x9E3779B97F4A7C15)
        columns.append(np.where(length >= max(n, 1), (mixed >> np.uint64(64 - BITS)).astype(np.int64), -1))
    return np.stack(columns, axis=1)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    cuts = np.flatnonzero(np.diff(size // SLICE_CHARS, prepend=0)) if len(size) else np.zeros(0, int)
    bounds = [0, *cuts[cuts > 0].tolist(), len(texts)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, sorted."""
    owner, word, vocabulary = _tokens(texts)
    found = _features(vocabulary)[word]
    pairs = ((owner.astype(np.int64) << BITS)[:, None] | np.maximum(found, 0))[found >= 0]
    pairs = np.unique(pairs)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _places(features: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a text and the place of one of its features in the sorted ``features``."""
    owner, word, vocabulary = _tokens(texts)
    if not len(features) or not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = _features(vocabulary)
    at = np.minimum(np.searchsorted(features, found), len(features) - 1)
    at = np.where(features[at] == found, at, -1)
    hits = np.flatnonzero((at >= 0).any(axis=1)[word])
    places = at[word[hits]]
    pairs = (owner[hits].astype(np.int64) * len(features))[:, None] + places
    return np.divmod(np.unique(pairs[places >= 0]), len(features))


def logits(model: Model, texts: pa.Array) -> np.ndarray:
    """The model's raw value of each text."""
    out = []
    for part in _slices(texts):
        text, feature = _places(model.features, part)
        out.append(model.bias + np.bincount(text, weights=model.weights[feature], minlength=len(part)))
    return np.concatenate(out) if out else np.zeros(0)


def probability(model: Model, raw: np.ndarray) -> np.ndarray:
    return _sigmoid(model.slope * raw + model.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# Training -----------------------------------------------------------------------------------------------------------


def _rows(owner: np.ndarray, feature: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the chosen texts, these numbered anew; pairs are sorted by text."""
    first, last = np.searchsorted(owner, texts), np.searchsorted(owner, texts, side="right")
    size = last - first
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.repeat(np.arange(len(texts)), size), feature[at]


def count_features(texts: DataFrame, features: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` (column text) each of the sorted features occurs, and their number.

    Tasks send a number for each feature; a text is read once and nothing of it is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(features), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in _slices(batch.column(0)):
                counts += np.bincount(_places(features, part)[1], minlength=len(features))
        there = np.flatnonzero(counts)
        place, number = np.append(there, -1), np.append(counts[there], n)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(number)], ["place", "n"])

    found = texts.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    rows = {r["place"]: r["n"] for r in found.collect()}
    return np.array([rows.get(i, 0) for i in range(len(features))], np.int64), rows.get(-1, 0)


def _apart(positive: np.ndarray, n_pos: int, others: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the share of each feature among toxic texts lies above that among ``n`` others: in deviations and as a ratio."""
    share_p, share_u = positive / n_pos, (others + 1) / (n + 1)
    return (share_p - share_u) / np.sqrt(share_u * np.maximum(1 - share_u, 1e-9) / n_pos), share_p / share_u


def chosen_features(sample: DataFrame, texts: DataFrame, n_pos: int, n_unl: int) -> np.ndarray:
    """Features whose share among the toxic texts of a sample (positive, unlabelled, features) is far above that among all ``texts``.

    Features that do not reach half of both limits in the sample are not counted further.
    """
    role = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    counts = sample.select("positive", "unlabelled", F.explode("features").alias("feature"))
    counts = counts.groupBy("feature").agg(role("positive"), role("unlabelled")).where(F.col("positive") >= LEAST_TEXTS)
    often = counts.toPandas().sort_values("feature")
    features, positive, unlabelled = (often[c].to_numpy(np.int64) for c in ("feature", "positive", "unlabelled"))
    z, ratio = _apart(positive, n_pos, unlabelled, n_unl)
    likely = (z >= Z_LEAST / 2) & (ratio >= RATIO_LEAST / 2)
    features, positive = features[likely], positive[likely]
    if not len(features):
        return features
    z, ratio = _apart(positive, n_pos, *count_features(texts, features))
    return features[(z >= Z_LEAST) & (ratio >= RATIO_LEAST)]


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative risk of raw values of toxic and of unlabelled texts, with the logistic loss."""
    negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    return float(prior * np.logaddexp(0, -positive).mean() + max(0.0, negative))


def risk_slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes by each raw value: those of the risk, or, where its second part is negative, the reverse of that part's."""
    sp, su = _sigmoid(positive), _sigmoid(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    if np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean() >= 0:
        return prior * (sp - 1) / n_p - prior * sp / n_p, su / n_u
    return prior * sp / n_p, -su / n_u


def train(kept: np.ndarray, owner, feature, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[Model, np.ndarray]:
    """Minimise the non-negative risk over pairs (text, place of its feature in ``kept``), sorted by text.

    ``positive`` and ``unlabelled`` are numbers of texts. Weights of features are at least 0. Returns the weights of all of
    ``kept`` beside the model, which has the positive ones.
    """
    rp, fp = _rows(owner, feature, positive)
    ru, fu = _rows(owner, feature, unlabelled)
    w, n = np.zeros(len(kept) + 1), len(kept)
    w[n] = np.log(prior / (1 - prior))
    moment, power, mean, seen, averaged = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0, 0
    rng = np.random.default_rng(SEED)
    batches = max(1, len(unlabelled) // BATCH)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-3
        parts = zip(
            np.array_split(rng.permutation(len(positive)), batches),
            np.array_split(rng.permutation(len(unlabelled)), batches),
        )
        for bp, bu in parts:
            if not len(bp) or not len(bu):
                continue
            r1, f1 = _rows(rp, fp, bp)
            r2, f2 = _rows(ru, fu, bu)
            gp = w[n] + np.bincount(r1, weights=w[f1], minlength=len(bp))
            gu = w[n] + np.bincount(r2, weights=w[f2], minlength=len(bu))
            cp, cu = risk_slopes(gp, gu, prior)
            slope = np.bincount(f1, weights=cp[r1], minlength=n + 1) + np.bincount(f2, weights=cu[r2], minlength=n + 1)
            slope[n] = cp.sum() + cu.sum()
            slope[:n] += SHRINK * w[:n]
            seen += 1
            moment = 0.9 * moment + 0.1 * slope
            power = 0.999 * power + 0.001 * slope * slope
            w -= rate * (moment / (1 - 0.9**seen)) / (np.sqrt(power / (1 - 0.999**seen)) + 1e-8)
            w[:n] = np.maximum(w[:n], 0)
            if epoch >= EPOCHS // 2:
                mean += w
                averaged += 1
    mean = mean / averaged if averaged else w
    used = np.flatnonzero(mean[:n] > 0)
    return Model(kept[used], mean[used], float(mean[n])), mean[:n]


def calibrated(model: Model, raw: np.ndarray, toxic: np.ndarray) -> Model:
    """The model with slope and offset fitted by logistic regression; unchanged unless both classes are there."""
    if len(set(toxic.tolist())) < 2:
        return model
    x, at = np.stack([raw, np.ones(len(raw))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ at)
        slope = x.T @ (toxic - p) - 1e-3 * (at - [1.0, 0.0])
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return Model(model.features, model.weights, model.bias, float(max(at[0], 1e-3)), float(at[1]))


def _draw(ids: DataFrame, seed: int, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of doc_id."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on the rows that are not held out."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    prior = marked.agg(F.avg("toxic")).first()[0]
    if not prior:
        return Model(np.zeros(0, np.int64), np.zeros(0), float("-inf"))
    prior = min(max(prior, 1e-4), 0.9)
    here = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = [
        _draw(here.where("toxic = 1"), 1, MAX_POSITIVE).select("doc_id", F.lit(1).alias("role"), F.lit(1).alias("toxic")),
        _draw(texts.select("doc_id").distinct(), 2, MAX_UNLABELLED).select("doc_id", F.lit(2), F.lit(0)),
        _draw(here, 3, MAX_LABELLED).select("doc_id", F.lit(3), "toxic"),
    ]
    roles = drawn[0].union(drawn[1]).union(drawn[2]).groupBy("doc_id").agg(
        F.max(F.col("role") == 1).alias("positive"),
        F.max(F.col("role") == 2).alias("unlabelled"),
        F.max(F.when(F.col("role") == 3, F.col("toxic"))).alias("toxic"),
    )
    roles = stored(roles, "toxicity-roles")
    n_pos, n_unl = (roles.where(c).count() for c in ("positive", "unlabelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, feature = text_features(batch.column("text"))
            count = np.bincount(owner, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "features"])

    # The sample's ids are bounded by the three limits.
    chosen = texts.join(F.broadcast(roles.select("doc_id")), "doc_id")
    found = chosen.mapInArrow(run, "doc_id long, features array<int>").dropDuplicates(["doc_id"]).join(roles, "doc_id")
    sample = stored(found, "toxicity-sample")
    kept = chosen_features(sample, texts, max(n_pos, 1), n_unl)
    if not n_pos or not len(kept):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))

    def only_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.full(1 << BITS, -1, np.int32)
        wanted[kept] = np.arange(len(kept))
        for batch in batches:
            lists = batch.column("features")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            place = wanted[pc.list_flatten(lists).to_numpy(zero_copy_only=False)]
            count = np.bincount(np.repeat(np.arange(len(size)), size)[place >= 0], minlength=len(size))
            short = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(place[place >= 0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], short], ["doc_id", "positive", "unlabelled", "toxic", "features"])

    columns = ["doc_id", "positive", "unlabelled", "toxic", "features"]
    kinds = "doc_id long, positive boolean, unlabelled boolean, toxic int, features array<int>"
    table = sample.select(*columns).mapInArrow(only_kept, kinds).toArrow().sort_by("doc_id")
    lists = table.column("features").combine_chunks()
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    feature = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = [np.flatnonzero(table.column(c).to_numpy()) for c in ("positive", "unlabelled")]
    model, weights = train(kept, owner, feature, *rows, prior)
    marked_rows = np.flatnonzero(pc.is_valid(table.column("toxic")).to_numpy())
    raw = model.bias + np.bincount(owner, weights=weights[feature], minlength=len(lists))[marked_rows]
    toxic = table.column("toxic").to_pandas().to_numpy()[marked_rows].astype(float)
    return calibrated(model, raw, toxic)


# Application --------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = pa.array(probability(model, logits(model, batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), value], ["doc_id", "held_out", "score"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all of their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = probability(model, logits(model, batch.column(text_col))) < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
