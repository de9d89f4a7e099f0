"""Quality classifier by co-training: a view of the words and a view of metadata teach each other.

A document is accepted if it is labelled good and not toxic. The text view is a logistic model over the presence of
vocabulary words; the metadata view one over binned figures of the document (size, lines, letter cases, symbols,
repetition), language and source. Over ``ROUNDS`` rounds each view labels the pool documents that it is sure of for the
other. Labelled documents kept out of fitting calibrate each view (Platt); others, kept out of both, fit how the two
combine; a last part, kept out of all of these, only measures (``Model.held_out``). Every document is scored.

Fitting uses at most about ``LABELLED`` labelled documents, half of them of each kind where there are as many, and
``POOL`` unlabelled ones, chosen by a hash of doc_id (documented bounds, whatever the corpus); word counts of that sample
are made in Spark. Languages and sources are counted over all documents, the ``NAMES`` most frequent of each have a weight
of their own. Models have a fixed size, so what is broadcast does not grow. Whole texts are read, in fitting and in scoring.

Defined cases: a null text is empty; a null language, source or ``doc_id`` is a value like others; labels with nulls are
left out, and of two labels of a document the worse counts; without a labelled document of either kind nothing can be told
apart, so nothing is rejected and scores are 1, else it is fitted on those there are; repeated rows score equally, two texts
under one id each by itself in ``quality_scores``, and both go in ``accepted`` if one is rejected; a score equal to the
threshold is kept; texts of any length are read whole, half a megabyte at a time or one text at a time; other columns are
kept by ``accepted``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, small_batches, text_steps, written
from .vectext import lower_ascii, text_bytes, word_hashes, word_spans

LABELLED, POOL, VOCABULARY, ROUNDS, NAMES = 8000, 4000, 4000, 3, 500
SURE, DEVIATIONS = 0.95, 4.0
#: Shares of the labelled documents that calibrate the views, join them, and measure; the rest is fitted on.
CALIBRATE, JOIN, MEASURE = 0.1, 0.06, 0.1
#: Bytes of text described at a time: some forty bytes of working arrays for each.
DESCRIBED = 1 << 19
#: Lengths in bytes of the word beginnings that count as words too, and the quantiles that bin figures.
STEMS = (4, 5, 6)
QUANTILES = np.array([0.01, 0.02, 0.05, *np.arange(0.1, 0.91, 0.1), 0.93, 0.95, 0.97, 0.98, 0.99])
BINS = len(QUANTILES) + 1
FIGURES = ["bytes", "words", "lines", "word_length", "line_words", "upper", "digits", "punctuation", "symbols", "spaces", "wide", "distinct", "repeats", "bangs"]
SCORE_SCHEMA = "doc_id long, text_score double, meta_score double, score double, keep boolean"


def _class(data: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, z in ranges:
        table[a : z + 1] = True
    return table[data]


def describe(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's set of hashed words, and a row of FIGURES."""
    data, offsets = text_bytes(column)
    letters = _class(data, [(48, 57), (65, 90), (97, 122), (128, 255)])
    # Words are runs of letters and digits here: blank out all else.
    plain = np.where(letters, lower_ascii(data), np.uint8(32))
    starts, ends, first = word_spans(plain, offsets)
    h = word_hashes(plain, starts, ends)
    # A word and its beginnings: inflected forms share them.
    stems = [np.where(ends - starts > k, word_hashes(plain, starts, np.minimum(starts + k, ends)) + np.uint64(k), h) for k in STEMS]
    # Runs of other signs are words as well.
    signs = np.where(letters | _class(data, [(9, 13), (32, 32)]), np.uint8(32), data)
    sign_starts, sign_ends, sign_first = word_spans(signs, offsets)
    sign_h = word_hashes(signs, sign_starts, sign_ends) + np.uint64(1)
    size = np.diff(offsets).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(mask))
        return (c[offsets[1:]] - c[offsets[:-1]]) / np.maximum(size, 1)

    n = np.diff(first).astype(float)
    again = np.append(0, np.cumsum(np.append(False, h[1:] == h[:-1]))) if len(h) else np.zeros(1)
    length = np.append(0, np.cumsum(ends - starts))
    distinct = [len(np.unique(h[a:z])) for a, z in zip(first[:-1], first[1:], strict=True)]
    upper = np.append(0, np.cumsum(_class(data[starts], [(65, 90)]) & _class(data[ends - 1], [(65, 90)]) & (ends - starts > 1))) if len(h) else np.zeros(1)
    # How often words repeat at once and how many are capitals, in tenths: words of the text view, too.
    tenths = [(10 * (c[first[1:]] - c[first[:-1]]) / np.maximum(n, 1)).astype(np.uint64) + np.uint64(k) for k, c in ((100, again), (200, upper))]
    sets = [
        np.unique(np.concatenate([h[a:z], *(x[a:z] for x in stems), sign_h[b:y], np.array([t[i] for t in tenths], np.uint64)]))
        for i, (a, z, b, y) in enumerate(zip(first[:-1], first[1:], sign_first[:-1], sign_first[1:], strict=True))
    ]
    lines = share(data == 10) * size + 1
    figures = np.column_stack(
        [
            np.log1p(size), np.log1p(n), np.log1p(lines), (length[first[1:]] - length[first[:-1]]) / np.maximum(n, 1), np.log1p(n / lines),
            share(_class(data, [(65, 90)])), share(_class(data, [(48, 57)])), share(_class(data, [(33, 34), (39, 41), (44, 47), (58, 59), (63, 63)])),
            share(_class(data, [(35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126)])), share(data == 32), share(_class(data, [(128, 255)])),
            np.array(distinct) / np.maximum(n, 1), (again[first[1:]] - again[first[:-1]]) / np.maximum(n, 1), share(data == 33),
        ]
    )
    return sets, figures


@dataclass
class Logistic:
    """Logistic model over sets of feature numbers."""

    size: int
    weights: np.ndarray = field(default=None)
    bias: float = 0.0

    def logits(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        c = np.append(0.0, np.cumsum(self.weights[idx]))
        return c[off[1:]] - c[off[:-1]] + self.bias

    def fit(self, idx: np.ndarray, off: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> Logistic:
        """Adam on the whole sample; the two kinds weigh alike."""
        self.weights, n = np.zeros(self.size), np.diff(off)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        m, v, mb, vb = np.zeros(self.size), np.zeros(self.size), 0.0, 0.0
        for t in range(1, steps + 1):
            err = (1 / (1 + np.exp(-np.clip(self.logits(idx, off), -30, 30))) - y) * weight
            g = np.bincount(idx, weights=np.repeat(err, n), minlength=self.size) + decay * self.weights
            gb = err.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            a, b = 1 - 0.9**t, 1 - 0.99**t
            self.weights -= rate * (m / a) / (np.sqrt(v / b) + 1e-9)
            self.bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-9)
        return self


def platt(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights (one for each column, then a bias) of a small logistic model, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        w -= np.linalg.solve(hess, x.T @ (p - y) + 1e-3 * w)
    return w


@dataclass
class Model:
    vocabulary: np.ndarray
    edges: np.ndarray
    names: dict[str, int]
    text: Logistic = None
    meta: Logistic = None
    text_platt: np.ndarray = None
    meta_platt: np.ndarray = None
    joint: np.ndarray = None
    #: Of labelled documents kept out of all fitting: how many there are, and the shares kept of good and rejected of bad ones.
    held_out: dict[str, float] = field(default_factory=dict)

    def word_features(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = [len(s) for s in sets]
        flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        k = np.minimum(np.searchsorted(self.vocabulary, flat), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[k] == flat if len(self.vocabulary) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(sets)), n)[known]
        return k[known], np.searchsorted(row, np.arange(len(sets) + 1))

    def meta_features(self, figures: np.ndarray, langs: list, sources: list) -> tuple[np.ndarray, np.ndarray]:
        cols = [np.searchsorted(self.edges[j], figures[:, j], "right") + j * BINS for j in range(len(FIGURES))]
        base = len(FIGURES) * BINS
        for kind, values in (("lang", langs), ("source", sources)):
            cols.append(np.array([base + self.names.get(f"{kind}:{v}", 0) for v in values], np.int64))
        out = np.column_stack(cols).astype(np.int64)
        return out.ravel(), np.arange(len(out) + 1) * out.shape[1]

    def meta_size(self) -> int:
        return len(FIGURES) * BINS + len(self.names) + 1

    def scores(self, words: tuple, metas: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text.logits(*words), self.meta.logits(*metas)
        out = [1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(t))]) @ w, -30, 30))) for x, w in ((t, self.text_platt), (m, self.meta_platt), (np.column_stack([t, m]), self.joint))]
        return out[0], out[1], out[2]


def _take(features: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx, off = features
    n = np.diff(off)[rows]
    at = np.repeat(off[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return idx[at], np.append(0, np.cumsum(n))


def parts_of(y: np.ndarray) -> list[np.ndarray]:
    """Labelled rows dealt at random within each kind: to fit on, to calibrate, to join, to measure. A kind with too few rows for a
    part lends that part its rows to fit on."""
    rng, parts = np.random.default_rng(5), [[], [], [], []]
    for kind in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == kind))
        cuts = np.cumsum([int(share * len(rows)) for share in (CALIBRATE, JOIN, MEASURE)])
        calibrate, join, measure, base = np.split(rows, cuts)
        for part, found in zip(parts, (base, calibrate, join, measure), strict=True):
            part.append(found if len(found) or part is parts[3] else base)
    return [np.concatenate(p) for p in parts]


def co_train(model: Model, words: tuple, metas: tuple, y: np.ndarray, prior: float = 0.0) -> Model:
    """y: 1 accepted, 0 rejected, -1 not labelled. prior: what the sample's log-odds of being accepted lack, as kinds are drawn apart."""
    pool = np.flatnonzero(y < 0)
    base, calibrate, join, measure = parts_of(y)
    told = {"text": {}, "meta": {}}  # pool row -> label that the other view gave
    for turn in range(ROUNDS + 1):
        views = {}
        for view, features, size in (("text", words, len(model.vocabulary)), ("meta", metas, model.meta_size())):
            rows = np.append(base, np.array(list(told[view]), np.int64))
            labels = np.append(y[base], np.array(list(told[view].values()), np.int64)).astype(float)
            fitted = Logistic(size).fit(*_take(features, rows), labels)
            scale = platt(fitted.logits(*_take(features, calibrate))[:, None], y[calibrate].astype(float)) + [0, prior]
            views[view] = (fitted, scale)
        if turn < ROUNDS and len(pool):
            for view, features, other in (("text", words, "meta"), ("meta", metas, "text")):
                fitted, scale = views[view]
                p = 1 / (1 + np.exp(-np.clip(fitted.logits(*_take(features, pool)) * scale[0] + scale[1], -30, 30)))
                for sure, label in ((p >= SURE, 1), (p <= 1 - SURE, 0)):
                    told[other].update((int(i), label) for i in pool[sure])
    model.text, model.text_platt = views["text"]
    model.meta, model.meta_platt = views["meta"]
    t, m = (f.logits(*_take(x, join)) for f, x in ((model.text, words), (model.meta, metas)))
    model.joint = platt(np.column_stack([t, m]), y[join].astype(float)) + [0, 0, prior]
    keep = model.scores(_take(words, measure), _take(metas, measure))[2] >= 0.5
    good = y[measure] == 1
    model.held_out = {"documents": len(measure), "good_kept": float(keep[good].mean()) if good.any() else np.nan, "bad_rejected": float(1 - keep[~good].mean()) if (~good).any() else np.nan}
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    KEPT.clear()
    for batch in batches:
        for a, z in text_steps(batch, "text", DESCRIBED):
            part = batch.slice(a, z - a)
            sets, figures = describe(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), part.column("lang").cast(pa.string()), part.column("source").cast(pa.string()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(list(figures), pa.list_(pa.float64()))], names=["doc_id", "y", "lang", "source", "words", "figures"])


def _numbered(held):
    """Words as numbers of the vocabulary, others left out: no row for each word, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Model(held.value, None, {})
        for batch in batches:
            sets = [w.values.to_numpy().view(np.uint64) for w in batch.column("words")]
            k, off = vocabulary.word_features(sets)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(k.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y", "lang", "source", "figures")), lists], names=["doc_id", "y", "lang", "source", "figures", "k"])

    return run


def frequent(docs: DataFrame, column: str) -> list[str]:
    """The NAMES most frequent values over all documents, as the names of features."""
    found = docs.groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(NAMES).collect()
    return [f"{column}:{r['v']}" for r in found]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None if there is no labelled document of a kind."""
    spark = docs.sparkSession
    small_batches(spark)
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    y = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(good).alias("y"))
    there = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs = docs.count()
    if len(there) < 2 or not n_docs:
        return None
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    of_kind = F.when(F.col("y") == 1, LABELLED / 2 / there[1]).otherwise(LABELLED / 2 / there[0])
    in_p = POOL / n_docs
    # Both draws are read off the same number, so labelled rows in the pool's share keep their labels.
    label = F.broadcast(y.where(draw < of_kind))  # about LABELLED rows
    chosen = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).join(label, "doc_id", "left")
    chosen = chosen.where(F.col("y").isNotNull() | (draw < in_p)).withColumn("y", F.coalesce("y", F.lit(-1)))
    sample = written(chosen.mapInArrow(_sampled, "doc_id long, y int, lang string, source string, words array<long>, figures array<double>"), "quality-sample")
    kinds = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (kinds.get(0) and kinds.get(1)):
        return None
    # Vocabulary: words of labelled sample documents that tell the kinds apart; VOCABULARY is the model's size.
    counts = sample.where("y >= 0").select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).where("p + q >= 5")
    # Log-odds in units of their own deviation, less what chance gives.
    tells = F.abs(F.log((F.col("p") + 1) / (kinds[1] + 2)) - F.log((F.col("q") + 1) / (kinds[0] + 2))) / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    words = np.sort(np.array([r["w"] for r in counts.where(tells >= DEVIATIONS).orderBy(tells.desc(), "w").limit(VOCABULARY).collect()], np.int64).view(np.uint64))
    held = spark.sparkContext.broadcast(words)
    # Sent to the driver: LABELLED + POOL rows of vocabulary numbers and figures, a repeated row once.
    numbered = sample.mapInArrow(_numbered(held), "doc_id long, y int, lang string, source string, figures array<double>, k array<int>")
    rows = numbered.dropDuplicates().orderBy("doc_id", "figures").collect()
    held.unpersist()
    figures = np.array([r["figures"] for r in rows])
    edges = np.array([np.quantile(figures[:, j], QUANTILES) for j in range(len(FIGURES))])
    names = sorted({*frequent(docs, "lang"), *frequent(docs, "source")})
    model = Model(words, edges, {v: i + 1 for i, v in enumerate(names)})
    sets = [np.array(r["k"], np.int64) for r in rows]
    features = np.concatenate([*sets, np.empty(0, np.int64)]), np.append(0, np.cumsum([len(s) for s in sets]))
    metas = model.meta_features(figures, [r["lang"] for r in rows], [r["source"] for r in rows])
    prior = np.log(there[1] / kinds[1]) - np.log(there[0] / kinds[0])
    return co_train(model, features, metas, np.array([r["y"] for r in rows]), prior)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) for every row of docs."""
    model = fit(docs, labels)
    if model is None:
        one = F.lit(1.0)
        return docs.select("doc_id", one.alias("text_score"), one.alias("meta_score"), one.alias("score"), F.lit(True).alias("keep"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        KEPT.clear()
        model = held.value
        for batch in batches:
            for a, z in text_steps(batch, "text", DESCRIBED):
                part = batch.slice(a, z - a)
                sets, figures = describe(part.column("text"))
                metas = model.meta_features(figures, part.column("lang").to_pylist(), part.column("source").to_pylist())
                t, m, p = model.scores(model.word_features(sets), metas)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(t), pa.array(m), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "text_score", "meta_score", "score", "keep"])

    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(score, SCORE_SCHEMA)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those rejected, all columns kept. Only ids travel to the join."""
    gone = written(quality_scores(docs, labels, threshold).where(~F.col("keep")).select("doc_id").distinct(), "rejected")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
