"""Toxicity (naive-Bayes-scaled character n-grams) and quality (ordinal cumulative link)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.textkit import chunks, lowered, mix64, span_hashes, word_spans
from rowloom.llm.workspace import Workspace, let_workers_import

_U = np.uint64

#: The bound of the sample that a classifier is fitted on, in labelled rows. Their texts are whole.
SAMPLE_ROWS = 6000


def fold(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


# --- features ---------------------------------------------------------------------------------


def _sorted_counts(rows: np.ndarray, cols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, count = np.unique(rows.astype(np.int64) * width + cols, return_counts=True)
    return key // width, key % width, count.astype(np.float64)


@dataclass(frozen=True)
class NgramSpec:
    """Character n-grams inside lower-cased words, a blank on either side counted as a character."""

    low: int = 3
    high: int = 5
    bits: int = 19


def word_ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spec: NgramSpec) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) for every byte n-gram of the padded words of one chunk."""
    padded = np.full(int((ends - starts).sum() + 2 * len(starts)), 0x20, dtype=np.uint8)
    length = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(length)])
    owner = np.repeat(np.arange(len(starts)), length)
    at = np.arange(len(padded)) - first[owner]
    inner = (at > 0) & (at < length[owner] - 1)
    padded[inner] = data[(starts[owner] + at - 1)[inner]]
    words, features = [], []
    for n in range(spec.low, spec.high + 1):
        begin = np.flatnonzero(at + n <= length[owner])
        words.append(owner[begin])
        features.append((span_hashes(padded, begin, begin + n, n) >> _U(64 - spec.bits)).astype(np.int64))
    return np.concatenate(words), np.concatenate(features)


def _distinct_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: rows, bytes, the spans of its distinct words, and each text's distinct words as (row, word)."""
    for at, end, data, offs in chunks(texts):
        data = lowered(data)
        starts, ends, firsts = word_spans(data, offs)
        _, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        row = np.repeat(np.arange(end - at), np.diff(firsts))
        row, word, _ = _sorted_counts(row, which, max(1, len(one)))
        yield at, end, data, starts[one], ends[one], row, word


def ngram_rows(texts: pa.Array, spec: NgramSpec, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature), distinct and in order, a chunk of texts at a time; only features marked in ``keep``."""
    for at, _, data, starts, ends, row, word in _distinct_words(texts):
        if not len(starts):
            continue
        owner, feature = word_ngrams(data, starts, ends, spec)
        if keep is not None:
            told = keep[feature]
            owner, feature = owner[told], feature[told]
        order = np.argsort(owner, kind="stable")
        count = np.bincount(owner, minlength=len(starts))
        first = np.concatenate([[0], np.cumsum(count)])
        reps = count[word]
        slot = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[word], reps)
        r, c, _ = _sorted_counts(np.repeat(row, reps), feature[order][slot], 1 << spec.bits)
        yield (r + at).astype(np.int32), c.astype(np.int32)


# --- a bounded sample of labelled texts -------------------------------------------------------


def labelled_sample(ws: Workspace, documents: DataFrame, labels: DataFrame, grade: F.Column, keep: F.Column | None, n: int) -> DataFrame:
    """Up to n labelled texts (doc_id, text, grade), an equal share of each grade where there are
    enough, taken in the order of a hash of their id, written to the shared folder.

    Only labels whose document exists are counted and taken. A doc_id labelled more than once
    has its highest grade; of rows that repeat a doc_id the least text is taken, so that n bounds the sample.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    if keep is not None:
        labels = labels.where(keep)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = ws.save(labels.groupBy("doc_id").agg(F.max("grade").alias("grade")).join(texts.select("doc_id"), "doc_id", "left_semi"), "labels")
    counts = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    room, share = n, {}
    for i, (g, have) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        share[g] = min(have, room // (len(counts) - i))
        room -= share[g]
    picked = known.limit(0)
    for g, take in share.items():
        picked = picked.unionByName(known.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id", F.lit(97)), "doc_id").limit(take))
    return ws.save(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")), "sample")


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """One list for each of n owners, which come in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values))


@dataclass(frozen=True)
class Features:
    """What the driver holds of the sample: a grade a text, and its features, (text, feature) or
    (text, feature, value)."""

    grades: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray | None = None


def _gathered(features: DataFrame) -> Features:
    """From (doc_id, grade, cols) and vals, if there are values; no more rows than the sample has."""
    got = features.toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        none = np.empty(0, dtype=np.int64)
        return Features(none, none, none, none)
    cols = got["cols"].combine_chunks()
    rows = np.repeat(np.arange(got.num_rows, dtype=np.int32), np.diff(cols.offsets.to_numpy()))
    values = got["vals"].combine_chunks().flatten().to_numpy() if "vals" in got.column_names else None
    return Features(got["grade"].to_numpy().astype(np.int64), rows, cols.flatten().to_numpy(), values)


# --- toxicity ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class ToxicityModel:
    spec: NgramSpec
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """As fitted: each weighty n-gram of a text counts once."""
        total = np.full(len(texts), self.bias)
        for rows, cols in ngram_rows(texts, self.spec, self.weights != 0.0):
            total += np.bincount(rows, weights=self.weights[cols], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


#: A feature counts when so many fitted texts hold it and its log-count ratio is so far from 0;
#: the sum over a long text is then not the noise of features that tell nothing.
LEAST_TEXTS = 4
LEAST_RATIO = 1.0


def log_count_ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """log((p + 1) / |p + 1|) - log((q + 1) / |q + 1|), of the numbers of toxic and other texts
    that hold each feature; 0 for features that tell nothing."""
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    ratio[(p + q < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0.0
    return ratio


def fit_toxicity(seen: Features, ratio: np.ndarray, spec: NgramSpec = NgramSpec(), steps: int = 100, ridge: float = 1e-2) -> ToxicityModel:
    """Logistic regression on binary n-gram features, each scaled by its log-count ratio.

    The ridge acts on the scaled features, so a feature's weight grows with the square of its
    ratio; fitted by accelerated gradient descent. Texts of the rarer class weigh as much
    together as the others. Without texts of both classes the score is the share of toxic
    texts (0.5 without any).
    """
    toxic = seen.grades.astype(np.float64)
    width = 1 << spec.bits
    if not len(toxic) or toxic.min() == toxic.max():
        share = (toxic.sum() + 0.5) / (len(toxic) + 1.0)
        return ToxicityModel(spec, np.zeros(width, dtype=np.float32), float(np.log(share / (1 - share))))
    rows, cols = seen.rows, seen.cols
    value = ratio[cols]
    weigh = np.where(toxic > 0, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())) / len(toxic)

    def times(w):
        return np.bincount(rows, weights=value * w[cols], minlength=len(toxic))

    def back(r):
        return np.bincount(cols, weights=value * r[rows], minlength=width)

    v, steep = np.ones(width), 1.0
    for _ in range(8):  # the largest curvature, by power iteration
        v = back(weigh * times(v))
        steep = np.linalg.norm(v) or 1.0
        v = v / steep
    rate = 1.0 / (0.25 * steep + 0.25 + ridge)
    w = ahead = np.zeros(width)
    bias = ahead_bias = 0.0
    for t in range(1, steps + 1):
        miss = (1.0 / (1.0 + np.exp(-np.clip(times(ahead) + ahead_bias, -40, 40))) - toxic) * weigh
        w2, bias2 = ahead - rate * (back(miss) + ridge * ahead), ahead_bias - rate * miss.sum()
        push = (t - 1) / (t + 2)
        ahead, ahead_bias = w2 + push * (w2 - w), bias2 + push * (bias2 - bias)
        w, bias = w2, bias2
    return ToxicityModel(spec, (w * ratio).astype(np.float32), float(bias))


def _text_counts(batches: Iterator[pa.RecordBatch], spec: NgramSpec) -> Iterator[pa.RecordBatch]:
    """(feature, p, q): how many toxic and other texts of these hold it."""
    p, q = (np.zeros(1 << spec.bits, dtype=np.int64) for _ in "pq")
    for batch in batches:
        toxic = batch["grade"].to_numpy() > 0
        for rows, cols in ngram_rows(batch["text"], spec):
            p += np.bincount(cols[toxic[rows]], minlength=len(p))
            q += np.bincount(cols[~toxic[rows]], minlength=len(q))
    held = np.flatnonzero(p + q)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held.astype(np.int32), p[held], q[held])], names=["feature", "p", "q"])


def _text_ngrams(batches: Iterator[pa.RecordBatch], spec: NgramSpec, keep) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        none = np.empty(0, dtype=np.int32)
        parts = [(none, none), *ngram_rows(batch["text"], spec, keep.value)]
        rows, cols = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], _lists(rows, cols, batch.num_rows)], names=["doc_id", "grade", "cols"])


def toxicity_model(sample: DataFrame, spec: NgramSpec = NgramSpec()) -> ToxicityModel:
    """Fitted on sample(doc_id, text, grade). Tasks read the texts; the driver gets the counts of
    at most 2 ** bits features, then the telling features of each text."""
    counts = sample.mapInArrow(partial(_text_counts, spec=spec), "feature int, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toArrow()
    p, q = (np.bincount(counts["feature"].to_numpy(), weights=counts[c].to_numpy(), minlength=1 << spec.bits) for c in "pq")
    ratio = log_count_ratio(p, q)
    keep = sample.sparkSession.sparkContext.broadcast(ratio != 0.0)
    seen = _gathered(sample.mapInArrow(partial(_text_ngrams, spec=spec, keep=keep), "doc_id long, grade int, cols array<int>"))
    keep.destroy()
    return fit_toxicity(seen, ratio, spec)


def _scored(batches: Iterator[pa.RecordBatch], score: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = score(batch["text"])
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), *(pa.array(c) for c in columns)],
                                         names=[*(c for c in batch.schema.names if c != "text"), *names])


def _kept(documents: DataFrame, keeps: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The documents, all columns, whose text a model keeps: one pass, no exchange."""
    rows = documents.select(F.struct("*").alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keeps(pc.struct_field(batch["doc"], "text").cast(pa.string()))))

    return rows.mapInArrow(run, rows.schema).select("doc.*")


def _shared(spark: SparkSession, model):
    let_workers_import(spark)
    return spark.sparkContext.broadcast(model)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Score every whole text for toxicity.

    The classifier is fitted on a bounded sample (``sample`` labelled rows at most, whose id's crc32
    modulo 4 is not 2, with their whole texts); labels, lang, source and doc_id are no inputs of a score. Result:
    doc_id, held_out (that remainder is 2), score (0 to 1), predicted (1 if score >= threshold).

    Null or empty texts get the score of a text without features; long ones are scored whole. Repeated rows give equal
    rows; a null doc_id counts as not held out and is never learnt from. A score equal to the threshold is toxic. Extra columns are ignored, an empty table
    gives an empty result, and without labels the score is constant.
    """
    model = _toxicity(documents, labels, sample)

    def score(texts: pa.Array):
        s = model.value.score(texts)
        return s, (s >= threshold).astype(np.int32)

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(lambda b: _scored(b, score, ["score", "predicted"]), "doc_id long, held_out boolean, score double, predicted int")


def _toxicity(documents: DataFrame, labels: DataFrame, sample: int):
    ws = Workspace(documents.sparkSession, "toxicity-fit")
    return _shared(documents.sparkSession, toxicity_model(labelled_sample(ws, documents, labels, F.col("toxic"), fold("doc_id", 4) != 2, sample)))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, all columns, that :func:`toxicity` would not predict toxic, each row by its own text."""
    model = _toxicity(documents, labels, sample)
    return _kept(documents, lambda texts: model.value.score(texts) < threshold)


# --- quality ----------------------------------------------------------------------------------

_SHAPE = np.full(256, 5, dtype=np.uint8)  # 0 blank, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 beyond ASCII
_SHAPE[:128] = 4
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3
_SHAPE[[0x20, *range(0x09, 0x0E)]] = 0


@dataclass(frozen=True)
class QualitySpec:
    bits: int = 14


def quality_features(texts: pa.Array, spec: QualitySpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): hashed text features, as roots of their shares in the text.

    Features: the shape of a word (classes of its first, middle and last characters, and a
    run of marks at its end), pairs of neighbouring shapes, pairs of neighbouring marks,
    whether a word equals the one before it or any earlier one, and the text's size.
    """
    width = 1 << spec.bits
    rows, cols, vals = [], [], []

    def put(row, code, n_texts, at, kind):
        col = (mix64(code.astype(_U) * _U(64) + _U(kind)) >> _U(64 - spec.bits)).astype(np.int64)
        r, c, n = _sorted_counts(row, col, width)
        rows.append(r + at)
        cols.append(c)
        vals.append(np.sqrt(n / np.maximum(1, np.bincount(row, minlength=n_texts))[r]))

    for at, end, data, offs in chunks(texts):
        n = end - at
        starts, ends, firsts = word_spans(data, offs)
        row = np.repeat(np.arange(n), np.diff(firsts))
        shape = _SHAPE[data]
        size = np.log2(np.diff(firsts) + 1.0).astype(np.int64)
        rows.append(np.arange(n) + at)
        cols.append((mix64(size.astype(_U) * _U(64)) >> _U(64 - spec.bits)).astype(np.int64))
        vals.append(np.ones(n))
        if not len(starts):
            continue
        middle, last2 = (starts + ends) // 2, np.maximum(starts, ends - 2)
        form = ((shape[starts] * 6 + shape[middle]) * 6 + shape[last2]) * 6 + shape[ends - 1]
        form = form.astype(np.int64) * 8 + np.minimum(7, ends - starts)
        put(row, form, n, at, 1)
        inside = row[1:] == row[:-1]
        put(row[1:][inside], (form[1:] * 65536 + form[:-1])[inside], n, at, 2)
        word = span_hashes(lowered(data), starts, ends)
        put(row[1:][inside], (word[1:] == word[:-1])[inside], n, at, 3)
        _, which = np.unique(word, return_inverse=True)
        pair, new = np.unique(row.astype(np.int64) * (int(which.max()) + 1) + which, return_index=True)
        seen = np.ones(len(row), dtype=np.int64)
        seen[new] = 0
        put(row, seen, n, at, 4)
        marks = np.flatnonzero((shape[1:] == 4) & (shape[:-1] == 4))
        if len(marks):
            owner = np.searchsorted(offs, marks, side="right") - 1
            put(owner, data[marks].astype(np.int64) * 256 + data[marks + 1], n, at, 5)
    none = np.empty(0)
    return np.concatenate([none, *rows]).astype(np.int64), np.concatenate([none, *cols]).astype(np.int64), np.concatenate([none, *vals])


@dataclass(frozen=True)
class QualityModel:
    """P(grade > k) = logistic(w x - cut[k]), cuts ascending."""

    spec: QualitySpec
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        r, c, v = quality_features(texts, self.spec)
        z = np.bincount(r, weights=v * self.weights[c], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -40, 40)))


def fit_quality(seen: Features, n_grades: int, spec: QualitySpec = QualitySpec(), steps: int = 300, ridge: float = 1e-4) -> QualityModel:
    """Maximum likelihood of the cumulative-link model by Adam; cuts are kept in order by
    fitting their logarithmic gaps. Each grade present weighs the same in total."""
    grades, rows, cols, vals = seen.grades, seen.rows, seen.cols, seen.values
    width, k = 1 << spec.bits, n_grades - 1
    if not len(grades):
        return QualityModel(spec, np.zeros(width), np.linspace(-1, 1, k) if k > 1 else np.zeros(k))
    count = np.bincount(grades, minlength=n_grades)
    weigh = 1.0 / (count[grades] * (count > 0).sum())
    free = np.zeros(width + k)
    free[width] = -1.0
    m1, m2 = np.zeros_like(free), np.zeros_like(free)
    n = len(grades)
    for t in range(1, steps + 1):
        cuts = free[width] + np.concatenate([[0.0], np.cumsum(np.exp(free[width + 1 :]))])
        z = np.bincount(rows, weights=vals * free[cols], minlength=n)
        tail = 1.0 / (1.0 + np.exp(-np.clip(z[:, None] - cuts, -40, 40)))
        bound = np.column_stack([np.ones(n), tail, np.zeros(n)])
        slope = np.column_stack([np.zeros(n), tail * (1 - tail), np.zeros(n)])
        i = np.arange(n)
        mass = np.maximum(bound[i, grades] - bound[i, grades + 1], 1e-12)
        g_z = -(slope[i, grades] - slope[i, grades + 1]) / mass * weigh
        g_cut = np.zeros((n, k + 2))
        g_cut[i, grades] += slope[i, grades] / mass * weigh
        g_cut[i, grades + 1] -= slope[i, grades + 1] / mass * weigh
        g_cut = g_cut[:, 1:-1].sum(axis=0)
        g = np.empty_like(free)
        g[:width] = np.bincount(cols, weights=vals * g_z[rows], minlength=width) + ridge * free[:width] / n
        g[width] = g_cut.sum()
        g[width + 1 :] = np.exp(free[width + 1 :]) * np.cumsum(g_cut[::-1])[::-1][1:]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        free -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    cuts = free[width] + np.concatenate([[0.0], np.cumsum(np.exp(free[width + 1 :]))])
    return QualityModel(spec, free[:width].copy(), cuts)


def _text_features(batches: Iterator[pa.RecordBatch], spec: QualitySpec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, cols, vals = quality_features(batch["text"], spec)
        order = np.argsort(rows, kind="stable")
        lists = (_lists(rows[order], x[order], batch.num_rows) for x in (cols.astype(np.int32), vals))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], *lists], names=["doc_id", "grade", "cols", "vals"])


def quality_model(sample: DataFrame, n_grades: int, spec: QualitySpec = QualitySpec()) -> QualityModel:
    """Fitted on sample(doc_id, text, grade). Tasks read the texts; the driver gets the features of each."""
    seen = sample.mapInArrow(partial(_text_features, spec=spec), "doc_id long, grade int, cols array<int>, vals array<double>")
    return fit_quality(_gathered(seen), n_grades, spec)


def quality(documents: DataFrame, labels: DataFrame, grade: F.Column | None = None, n_grades: int = 3,
            threshold: float = 0.5, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Grade every whole text by ordinal regression on hashed text features.

    ``grade`` is an expression over ``labels`` giving 0 .. n_grades - 1; by default 0 for low
    quality, 1 for good but toxic and 2 for good text. The model is fitted on a bounded sample of
    ``sample`` labelled rows whose id's crc32 modulo 4 is not 2. Result: doc_id, held_out,
    expected_grade, p_good (probability of grade 1 or more), predicted_grade (the likeliest),
    selected (p_good >= threshold).

    Null or empty texts are graded by their size feature alone. Repeated rows give equal
    rows; a null doc_id counts as not held out. Extra columns are ignored, an empty table
    gives an empty result; labels outside the grades, or null, are not learnt from.
    """
    model = _quality(documents, labels, grade, n_grades, sample)

    def score(texts: pa.Array):
        tails = model.value.tails(texts)
        mass = -np.diff(np.column_stack([np.ones(len(tails)), tails, np.zeros(len(tails))]), axis=1)
        return tails.sum(axis=1), tails[:, 0].copy(), mass.argmax(axis=1).astype(np.int32), tails[:, 0] >= threshold

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(
        lambda b: _scored(b, score, ["expected_grade", "p_good", "predicted_grade", "selected"]),
        "doc_id long, held_out boolean, expected_grade double, p_good double, predicted_grade int, selected boolean",
    )


def _quality(documents: DataFrame, labels: DataFrame, grade: F.Column | None, n_grades: int, sample: int):
    if grade is None:
        grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    grade = F.when(grade.between(0, n_grades - 1), grade)
    ws = Workspace(documents.sparkSession, "quality-fit")
    return _shared(documents.sparkSession, quality_model(labelled_sample(ws, documents, labels, grade, fold("doc_id", 4) != 2, sample), n_grades))


def without_poor(documents: DataFrame, labels: DataFrame, grade: F.Column | None = None, n_grades: int = 3, threshold: float = 0.5, sample: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, all columns, that :func:`quality` would select, each row by its own text."""
    model = _quality(documents, labels, grade, n_grades, sample)
    return _kept(documents, lambda texts: model.value.tails(texts)[:, 0] >= threshold)
