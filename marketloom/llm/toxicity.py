"""Toxicity scores from a counterfactual-regularised classifier.

The model is a logistic regression over which words and word beginnings (of four to six bytes) a text
contains. It is fitted on labelled texts; the loss has a second term: every labelled text that
names groups of people is given a twin in which these terms are swapped for others of their kind, and
the squared difference between the two scores (before the logistic function) is penalised. A group
term thus can't raise a score by itself, and neutral mentions aren't taken for toxic ones.

Fitting uses a sample of at most ``SAMPLE`` labelled texts of each label (those with the smallest
hashes of their ids) and the ``FEATURES`` features that tell the labels apart best, counted over the
whole texts of the sample; both are bounded, so the model is fitted in one place. Scoring reads every
whole text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import words as W
from marketloom.llm.sample import by_hash
from marketloom.session import written

SAMPLE = 6_000
FEATURES = 4_096
#: Features seen in fewer texts of the sample are not looked at.
LEAST = 2
HEADS = (4, 5, 6)
#: Features counted at once.
SPAN = 1 << 21
PENALTY, SWAP_PENALTY = 1e-4, 1.0

#: Terms that name groups of people, by kind; a term is swapped for the next one of its row.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girl", "boy"),
    ("christian", "muslim", "jewish", "buddhist", "hindu", "atheist"),
    ("christians", "muslims", "jews", "buddhists", "hindus", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("american", "german", "french", "spanish", "mexican", "chinese", "turkish", "russian"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("ausländer", "einheimische", "flüchtlinge"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)
_NEXT = {term: row[(k + 1) % len(row)] for row in IDENTITY_TERMS for k, term in enumerate(row)}
_TERM = regex.compile(r"\b(?:" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", regex.IGNORECASE)


def swapped(text: str) -> str:
    """The text with every group term replaced by the next of its kind."""
    return _TERM.sub(lambda m: _NEXT[m[0].lower()], text)


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, text of each feature, features) by blocks of texts; not yet distinct."""
    for start, end, data, bounds in W.blocks(pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))):
        found = W.words(data, bounds, W.LETTERS, HEADS)
        owner = np.repeat(np.arange(end - start), np.diff(found.first))
        longer = {k: found.lengths > k for k in HEADS}
        heads = [W.mix(found.prefixes[k][longer[k]] + np.uint64(k)) for k in HEADS]
        yield start, end, np.concatenate([owner, *(owner[longer[k]] for k in HEADS)]), np.concatenate([found.hashes, *heads])


def _once(owner: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once, by text and feature."""
    order = np.lexsort((features, owner))
    owner, features = owner[order], features[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (features[1:] != features[:-1]))[: len(owner)]
    return owner[new], features[new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, texts with label 0, texts with label 1) of parts of the sample."""
    names = ["feature", "clean", "toxic"]

    def counts(found: list[np.ndarray], labels: list[np.ndarray]) -> pa.RecordBatch:
        values, place = np.unique(np.concatenate(found), return_inverse=True)
        toxic = np.bincount(place, np.concatenate(labels), len(values)).astype(np.int64)
        return pa.record_batch([pa.array(values.astype(np.int64)), pa.array(np.bincount(place, minlength=len(values)) - toxic), pa.array(toxic)], names=names)

    found, labels = [], []
    for batch in batches:
        label = batch.column("label").to_numpy()
        for start, _, owner, features in _features(batch.column("text")):
            owner, features = _once(owner, features)
            found.append(features)
            labels.append(label[start + owner])
            if sum(map(len, found)) >= SPAN:
                yield counts(found, labels)
                found, labels = [], []
    if found:
        yield counts(found, labels)


@dataclass
class Model:
    """Features in ascending order, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def present(self, column: pa.Array) -> list[np.ndarray]:
        """For each text the places of the model's features in it."""
        low = np.uint64((1 << 20) - 1)
        maybe = np.zeros(1 << 20, bool)
        maybe[(self.features & low).astype(np.int64)] = True
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(column)
        for start, end, owner, features in _features(column):
            near = maybe[(features & low).astype(np.int64)]
            owner, features = owner[near], features[near]
            place = np.minimum(np.searchsorted(self.features, features), max(0, len(self.features) - 1))
            known = self.features[place] == features if len(self.features) else np.zeros(0, bool)
            owner, place = _once(owner[known], place[known])
            cuts = np.searchsorted(owner, np.arange(end - start + 1))
            for k in range(end - start):
                out[start + k] = place[cuts[k] : cuts[k + 1]]
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        margins = np.array([self.weights[x].sum() for x in self.present(column)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def _fitted(own: list, twin: list, label: np.ndarray, weight: np.ndarray, features: int, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent. ``own`` and ``twin`` hold the features of
    each text and of its twin (None without one), ``weight`` what each text counts for."""

    def gather(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)

    paired = [k for k, t in enumerate(twin) if t is not None]
    x, base, other = gather(own), gather([own[k] for k in paired]), gather([twin[k] for k in paired])
    n, m = len(own), len(paired)
    weight = weight / weight.sum()

    def margin(w: np.ndarray) -> np.ndarray:
        return np.bincount(x[0], w[x[1]], n)

    def back(errors: np.ndarray) -> np.ndarray:
        return np.bincount(x[1], errors[x[0]], features)

    def swap_pull(w: np.ndarray) -> np.ndarray:
        """Gradient of the mean squared difference between the scores of twins."""
        if not m:
            return np.zeros(features)
        apart = (np.bincount(base[0], w[base[1]], m) - np.bincount(other[0], w[other[1]], m)) * (2 * SWAP_PENALTY / m)
        return np.bincount(base[1], apart[base[0]], features) - np.bincount(other[1], apart[other[0]], features)

    direction, steepest = np.ones(features), 1.0
    for _ in range(30):  # the largest curvature bounds the step
        steepest = max(float(np.linalg.norm(direction)), 1e-12)
        direction = direction / steepest
        direction = 0.25 * back(weight * margin(direction)) + swap_pull(direction)
    rate = 1 / (1.5 * steepest + 0.25 + PENALTY)
    w, b = np.zeros(features), 0.0
    ahead, ahead_b, momentum = w, b, 1.0
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(margin(ahead) + ahead_b, -30, 30))) - label)
        grad = back(error) + PENALTY * ahead + swap_pull(ahead)
        new, new_b = ahead - rate * grad, ahead_b - rate * error.sum()
        momentum = 1.0 if (new - w) @ grad > 0 else momentum
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        pull = (momentum - 1) / following
        ahead, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b, momentum = new, new_b, following
    return w, b


def _told_apart(counts: DataFrame, clean: int, toxic: int, features: int) -> np.ndarray:
    """The features with the largest chi-squared statistic between the labels."""
    share = toxic / (clean + toxic)
    seen = F.col("clean") + F.col("toxic")
    spread = seen * F.lit(share * (1 - share)) * (1 - seen / F.lit(clean + toxic + 1))
    best = (
        counts.groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(seen >= LEAST)
        .withColumn("chi", F.pow(F.col("toxic") - seen * F.lit(share), F.lit(2.0)) / spread)
        .orderBy(F.desc("chi"), "feature")
        .limit(features)
        .toArrow()
    )
    return np.sort(best.column("feature").to_numpy().astype(np.uint64))


def fit(
    texts: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample: int = SAMPLE,
    features: int = FEATURES,
) -> Model:
    """A model from the rows of ``labels`` (id, label 0 or 1) and the texts they name.

    NULL labels and ids take no part; an id labelled both ways counts as toxic; a NULL text is empty.
    Without texts of both labels, every text gets the share of toxic ones (0.5 without any).
    """
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    marks = marks.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    marks = written(marks, "marks")
    drawn = [by_hash(marks.where(F.col("label") == k), "id", sample) for k in (0, 1)]
    drawn = written(drawn[0].unionByName(drawn[1]), "drawn")
    rows = texts.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = written(rows.join(F.broadcast(drawn), "id"), "labelled")  # at most 2 * sample ids
    total = dict(marks.groupBy("label").count().collect())
    used = dict(rows.groupBy("label").count().collect())
    if len(used) < 2:
        share = {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(used)]
        return Model(np.zeros(0, np.uint64), np.zeros(0), 60.0 * share - 30.0)
    counts = rows.select("text", "label").mapInArrow(_counted, "feature long, clean long, toxic long")
    model = Model(_told_apart(counts, used[0], used[1], features), np.zeros(0), 0.0)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The label of each text with its features and those of its twin, if it has one."""
        for batch in batches:
            own = model.present(batch.column("text"))
            other = [swapped(t) if t and _TERM.search(t) else None for t in batch.column("text").to_pylist()]
            twins = iter(model.present(pa.array([t for t in other if t is not None], pa.string())))
            twins = [None if t is None else next(twins) for t in other]
            kind = pa.list_(pa.int64())
            yield pa.record_batch([batch.column("label"), pa.array(own, kind), pa.array(twins, kind)], names=["label", "own", "twin"])

    # At most 2 * sample rows of at most ``features`` places, in practice a few for each text.
    found = rows.select("text", "label").mapInArrow(gathered, "label int, own array<long>, twin array<long>").toArrow()
    label = found.column("label").to_numpy()
    own = [np.asarray(x, np.int64) for x in found.column("own").to_pylist()]
    twin = [None if x is None else np.asarray(x, np.int64) for x in found.column("twin").to_pylist()]
    weight = np.where(label == 1, total[1] / used[1], total[0] / used[0])
    weights, bias = _fitted(own, twin, label, weight, len(model.features))
    return Model(model.features, weights, bias)


def score(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ``score``, ``predicted``) of every row: 0 to 1, higher for texts more likely toxic.

    A NULL text is scored as the empty one; NULL and repeated ids are kept. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array(shared.value.scores(batch.column("text")), pa.float64())], names=["id", "score"])

    kind = df.select(id_column).dtypes[0][1]
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(scored, f"id {kind}, score double").select(
        F.col("id").alias(id_column), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def held_out(id_column: str = "doc_id"):
    """Whether a row is kept from the fit: CRC-32 of its id as text is a multiple of 5."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def classified(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document with ``held_out``, ``score`` and ``predicted``, by a model that has seen none of the
    labels of held-out rows."""
    model = fit(documents, labels.where(~held_out(id_column)), id_column, text_column)
    return score(documents, model, id_column, text_column).select(
        id_column, F.coalesce(held_out(id_column), F.lit(False)).alias("held_out"), "score", "predicted"
    )


def without_toxic(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` whose own text scores below 0.5, columns as they are."""
    model = fit(documents, labels.where(~held_out(id_column)), id_column, text_column)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text_column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(place)) < 0.5))

    return documents.mapInArrow(kept, documents.schema)
