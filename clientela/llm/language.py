"""Language identification by hierarchical discrimination.

Features are relative frequencies of hashed byte trigrams of the lower-cased text. A first set of linear
support vector machines, one against one, tells families of languages apart; within the chosen family,
machines of each pair of its languages vote. All are trained here on a bounded sample of labelled rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm import texts
from clientela.llm.tables import ship

UNDETERMINED = "und"
BUCKET_BITS = 12
SAMPLE_ROWS = 2000
LEAST_ROWS = 20
EPOCHS = 30
#: Families of ISO 639-1 codes. Any other label is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(label: str) -> str:
    return _FAMILY_OF.get(label.split("-")[0].lower(), label)


def _trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bucket of each trigram, where each text's trigrams start); texts are framed by spaces."""
    framed = pc.binary_join_element_wise(
        pa.scalar("", pa.large_string()), pc.utf8_lower(column), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    )
    data, offsets = texts.flat(framed)
    for first, last in texts.slices(offsets):
        at = offsets[first : last + 1]
        part = data[at[0] : at[-1]].astype(np.uint32)
        at = at - at[0]
        if len(part) < 3:
            yield first, last, np.zeros(0, np.uint32), np.zeros(last - first + 1, np.int64)
            continue
        gram = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        gram = (gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
        inside = np.ones(len(gram), bool)
        for back in (1, 2):  # trigrams that reach into the next text
            edge = at[1:-1] - back
            inside[edge[(edge >= 0) & (edge < len(gram))]] = False
        starts = np.concatenate([[0], np.cumsum(inside)])[np.minimum(at, len(gram))]
        yield first, last, gram[inside], starts


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _sum_by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


@dataclass
class LanguageModel:
    """Families, their languages, and one row of weights per machine (the last entry is the bias)."""

    families: dict[str, list[str]]
    family_pairs: list[tuple[str, str]]
    language_pairs: list[tuple[str, str]]
    weights: np.ndarray

    @property
    def languages(self) -> list[str]:
        return sorted(itertools.chain.from_iterable(self.families.values()))

    def predict(self, margins: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        n, split = len(margins), len(self.family_pairs)
        names = sorted(self.families)
        chosen, sure = _vote(margins[:, :split], names, self.family_pairs)
        labels: list[str | None] = [None] * n
        score = np.zeros(n)
        for k, family in enumerate(names):
            rows = np.flatnonzero(chosen == k)
            members = self.families[family]
            at = [split + i for i, (a, _) in enumerate(self.language_pairs) if a in members]
            best, sure_within = _vote(margins[np.ix_(rows, at)], members, [self.language_pairs[i - split] for i in at])
            for row, choice in zip(rows.tolist(), best.tolist()):
                labels[row] = members[choice]
            score[rows] = sure[rows] * sure_within
        return labels, score


def _vote(margins: np.ndarray, names: list[str], pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The name with most votes (ties: larger sum of margins, then first name), and how sure its weakest vote is."""
    n = len(margins)
    votes, sums, weakest = np.zeros((n, len(names))), np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
    for k, (a, b) in enumerate(pairs):
        for name, margin in ((a, margins[:, k]), (b, -margins[:, k])):
            i = names.index(name)
            votes[:, i] += margin > 0
            sums[:, i] += margin
            weakest[:, i] = np.minimum(weakest[:, i], margin)
    rank = votes + 0.5 * (1 + sums / (1 + np.abs(sums).max(axis=1, keepdims=True) if n else 1)) * 0.99
    best = rank.argmax(axis=1) if n else np.zeros(0, int)
    weak = weakest[np.arange(n), best]
    return best, 1 / (1 + np.exp(-np.clip(3 * weak, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, epochs: int, strength: float = 1e-4) -> np.ndarray:
    """A linear support vector machine: hinge loss, averaged stochastic subgradient, rows in a fixed random order."""
    rng = np.random.default_rng(7)
    w = np.zeros(x.shape[1], np.float32)
    mean, steps = np.zeros(x.shape[1]), 0
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            steps += 1
            wrong = y[rows] * (x[rows] @ w) < 1
            rate = 1 / (1 + 0.02 * steps)
            w *= 1 - rate * strength
            w += rate * (weight[rows] * wrong * y[rows]).astype(np.float32) @ x[rows] / len(rows)
            if epoch >= epochs // 2:
                mean += w
    return mean / max(1, steps - (epochs // 2) * max(1, len(y) // 32))


def _collect_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, grams, starts in _trigrams(texts.as_strings(batch.column(0))):
            for k in range(last - first):
                bucket, count = np.unique(grams[starts[k] : starts[k + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first + k, 1), pa.array([bucket.astype(np.uint16).tobytes()], pa.binary()), pa.array([count.astype(np.uint32).tobytes()], pa.binary())],
                    names=["label", "buckets", "counts"],
                )


def train(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> LanguageModel | None:
    """Fit on a sample of about ``rows`` labelled rows, evenly over labels; None if no row has a label.

    The sample takes the different texts with the smallest hash, a part of each label's so large that
    ``rows`` / number of labels are expected (20 at least, so that no label is lost); it may be up to a fifth
    larger. Copies of a text count once. Whole texts are counted.
    """
    ship(labelled.sparkSession)
    source = labelled.select(F.col(text_column).cast("string").alias("text"), F.col(label_column).cast("string").alias("label"))
    source = source.where("label is not null and text is not null")
    # copies of a text count once, here and in the sample, so that a label of copies keeps its rows
    different = source.select("label", F.xxhash64("text", F.lit(11)).alias("place")).distinct()
    sizes = {r.label: r["count"] for r in different.groupBy("label").count().collect()}
    if not sizes:
        return None
    each = max(LEAST_ROWS, rows / len(sizes))
    share = {label: min(1.0, each / n) for label, n in sizes.items()}
    cut = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(int(v * (2**31 - 1)))) for k, v in share.items()))
    place = F.xxhash64("text", F.lit(11)).bitwiseAND(F.lit(2**31 - 1))
    sample = source.where(place <= cut[F.col("label")]).distinct()  # copies of a text share its place
    found = sample.mapInArrow(_collect_counts, "label string, buckets binary, counts binary")
    found = found.orderBy(F.xxhash64("buckets", "counts"), "label", "buckets").limit(int(1.2 * each * len(sizes)) + 50).collect()
    # a column for each bucket and one for the bias; all work is done in place
    x = np.zeros((len(found), (1 << BUCKET_BITS) + 1), np.float32)
    label_list = [r.label for r in found]
    labels = np.array(label_list)
    for row, r in zip(x, found):
        row[np.frombuffer(r.buckets, np.uint16)] = np.frombuffer(r.counts, np.uint32)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    scale = 1 / np.sqrt(x[:, :-1].mean(axis=0) + 1e-4)
    scale /= np.sqrt(np.einsum("ij,ij,j->i", x[:, :-1], x[:, :-1], scale**2).mean()) or 1.0
    x[:, :-1] *= scale
    x[:, -1] = 1
    families: dict[str, list[str]] = {}
    for label in sorted(set(label_list)):
        families.setdefault(family_of(label), []).append(label)
    family_pairs = list(itertools.combinations(sorted(families), 2))
    language_pairs = [pair for members in families.values() for pair in itertools.combinations(members, 2)]
    family = np.array([family_of(label) for label in label_list])
    weights = []
    for names, pairs in ((family, family_pairs), (labels, language_pairs)):
        for a, b in pairs:
            rows_in = (names == a) | (names == b)
            w = _machine(x[rows_in], np.where(names[rows_in] == a, 1.0, -1.0), epochs)
            weights.append(np.r_[w[:-1] * scale, w[-1]])
    return LanguageModel(families, family_pairs, language_pairs, np.array(weights).reshape(-1, (1 << BUCKET_BITS) + 1))


def _predict(model: LanguageModel | None):
    weights = model.weights[:, :-1].T.astype(np.float32).copy() if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts.as_strings(batch.column(1))
            for first, last, grams, starts in _trigrams(column):
                here = batch.slice(first, last - first)
                labels: list[str] = [UNDETERMINED] * (last - first)
                score = np.zeros(last - first)
                if model:
                    many = np.maximum(np.diff(starts), 1)
                    margins = np.empty((last - first, weights.shape[1]))
                    for k in range(weights.shape[1]):
                        margins[:, k] = _sum_by_text(weights[:, k][grams], starts) / many + model.weights[k, -1]
                    found, sure = model.predict(margins)
                    letters = [_has_letter(t) for t in here.column(1).to_pylist()]
                    labels = [f if ok else UNDETERMINED for f, ok in zip(found, letters)]
                    score = np.where(letters, sure, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [here.column(0), pa.array(labels, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"]
                )

    return run


def predict(docs: DataFrame, model: LanguageModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1).

    ``und`` with score 0 if the text is null, empty or has no letter, or if there is no model. Only the text
    is used. With one learned language, all texts with a letter get it, with score 1. Repeated rows: each
    is predicted. A null id stays null. Empty table: no rows. Other columns are not read. Whole texts are read.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def keep_determined(docs: DataFrame, model: LanguageModel, text_column: str = "text", fill_column: str | None = None) -> DataFrame:
    """The rows, with all their columns, whose text has a letter and so gets one of the model's languages.

    Nulls of ``fill_column`` become the predicted language.
    """
    ship(docs.sparkSession)
    place = docs.columns.index(text_column)
    fill = docs.columns.index(fill_column) if fill_column else None
    predict_batch = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_only = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(place).cast(pa.string())], names=["doc_id", "text"])
            labels = [label for part in predict_batch(iter([texts_only])) for label in part.column(1).to_pylist()]
            columns = [*batch.columns]
            if fill is not None:
                columns[fill] = pc.coalesce(columns[fill], pa.array(labels, columns[fill].type))
            batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch.filter(pa.array([label != UNDETERMINED for label in labels], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
