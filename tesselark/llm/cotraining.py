"""Operator 2: a co-trained quality classifier over two views.

The content view sees a text's words and character classes, the metadata view only the page's source, language and
length. Each view is a logistic regression. In each round either view scores all rows that are not in the labelled sample and labels the PER_ROUND
of them it is surest of, in the classes' proportion; the other view learns these as well. On labels held out each view is then
calibrated (Platt), and every document gets the product of both views' odds over the prior odds.

Toxicity is a second target, trained the same way. A few words tell it, which the content view's hashed and scaled counts drown; so its content
view is whether each of N_TOXIC words occurs, those of the greatest likelihood ratio of the labelled sample (rows held out for calibration not counted).
Source and language may say nothing of toxicity; where the pseudo-labels raise the loss on the rows held out, the fit without them is taken.
It leaves quality's score as it is.

Only the labelled sample is bounded: at most MAX_LABELLED ids of least hash, one row each, are fitted on. Texts are read once, into a table
of features, sparse and about a third of the texts' size; each round passes over that table. The driver gets the
sample's features and, each round, those of the rows just labelled. Nothing is shuffled but ids, margins and a few rows.

Defined cases: null text is empty; null source or language is a value of its own; rows without both labels in the sample get the prior (toxic only above one half);
repeated rows get equal scores and count once when rows are picked; of rows of one labelled id that of least hash is fitted on; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm.common import column, discard, documents, text_of, written

MAX_LABELLED, PER_ROUND, ROUNDS, HELD_OUT, SURE = 4000, 320, 4, 5, 1.0
N_WORDS, N_SHAPE, N_METADATA, N_NAMES = 1024, 10, 256, 4
N_CONTENT = N_WORDS + N_SHAPE
KNOWN_WORDS, ROWS_AT_ONCE, MERGERS = 300_000, 256, 64
N_TOXIC, LEAST_HOLDERS, LONGEST_WORD = 256, 3, 64
L2, TOXIC_L2 = 1e-3, 1e-4
WORD = re.compile(r"\w+")
CLASSES = (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?")
TABLE = "doc_id long, h long, words binary, shape binary, names binary, bits binary"


# features


class Features:
    """Both views' features of rows; a word's number is kept for at most KNOWN_WORDS words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.bucket: list[int] = []

    def words(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Row and word number of every word, row by row."""
        flat = [w for x in texts for w in x]
        new = set(flat).difference(self.number)
        if len(self.number) + len(new) > KNOWN_WORDS:
            self.number, self.bucket, new = {}, [], set(flat)
        for w in sorted(new):
            self.number[w] = len(self.bucket)
            self.bucket.append(xxhash.xxh3_64_intdigest(w) % N_WORDS)
        numbers = np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat))
        return np.repeat(np.arange(len(texts)), [len(x) for x in texts]), numbers

    def content(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Per text its word features (buckets as uint16, then their values as float16) and its shape (float32)."""
        raw = [t.encode("utf-8") for t in texts]
        split = [r.split() for r in raw]
        rows, numbers = self.words(split)
        n_words = np.array([len(x) for x in split])
        distinct = np.bincount(np.unique(rows * (len(self.bucket) + 1) + numbers) // (len(self.bucket) + 1), minlength=len(texts))
        again = np.bincount(rows[1:][(numbers[1:] == numbers[:-1]) & (rows[1:] == rows[:-1])], minlength=len(texts))
        cells, times = np.unique(rows * N_WORDS + np.array(self.bucket, dtype=np.int64)[numbers] if len(rows) else np.empty(0, np.int64), return_counts=True)
        at, value = cells // N_WORDS, np.log1p(times.astype(np.float32))
        norm = np.sqrt(np.bincount(at, weights=value**2, minlength=len(texts)))
        value = (value * (4 / np.maximum(1.0, norm))[at]).astype(np.float16)
        ends = np.cumsum(np.bincount(at, minlength=len(texts)))
        buckets = (cells % N_WORDS).astype(np.uint16)
        words = [buckets[i:j].tobytes() + value[i:j].tobytes() for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        size, k = np.maximum(1, [len(r) for r in raw]), np.maximum(1, n_words)
        shares = [np.array([len(r) - len(r.translate(None, c)) for r in raw]) / size for c in CLASSES]
        lines = np.array([r.count(b"\n") + 1 for r in raw])
        shape = np.stack([*shares, distinct / k, again / k, size / k / 10, k / lines / 100, k < 12], axis=1).astype(np.float32) * 3
        return words, [s.tobytes() for s in shape]

    @staticmethod
    def names(lang: str | None, source: str | None, length: int) -> bytes:
        size = min(20, int(np.log2(length + 1)))
        return bytes(xxhash.xxh3_64_intdigest(x) % N_METADATA for x in (f"lang={lang}", f"source={source}", f"size={size}", f"lang={lang} source={source}"))


def words_of(text: str) -> set[str]:
    return {w for w in WORD.findall(text.lower()) if len(w) <= LONGEST_WORD}


def presence(texts: list[str], number: dict[str, int]) -> list[bytes]:
    """Bits, by a word's number, of whether a text holds it."""
    out = np.zeros((len(texts), N_TOXIC), dtype=np.uint8)
    for row, t in zip(out, texts, strict=True):
        row[[number[w] for w in words_of(t) & number.keys()]] = 1
    return [r.tobytes() for r in np.packbits(out, axis=1)]


@dataclass
class Views:
    """Features of some rows of TABLE."""

    rows: np.ndarray  # of each word feature
    buckets: np.ndarray
    values: np.ndarray
    shape: np.ndarray
    names: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, part: pa.RecordBatch | pa.Table) -> Views:
        words = part["words"].to_pylist()
        n = np.array([len(w) // 4 for w in words], dtype=np.int64)
        join = lambda xs, kind, width: np.frombuffer(b"".join(xs), dtype=kind).reshape(len(xs), width)
        return cls(
            np.repeat(np.arange(len(words)), n),
            np.frombuffer(b"".join(w[: len(w) // 2] for w in words), dtype=np.uint16).astype(np.int64),
            np.frombuffer(b"".join(w[len(w) // 2 :] for w in words), dtype=np.float16).astype(np.float32),
            join(part["shape"].to_pylist(), np.float32, N_SHAPE),
            join(part["names"].to_pylist(), np.uint8, N_NAMES).astype(np.int64),
            np.unpackbits(join(part["bits"].to_pylist(), np.uint8, N_TOXIC // 8), axis=1).astype(np.float32),
        )

    def margin(self, view: str, w: np.ndarray) -> np.ndarray:
        """Inner product of a view (content, names or bits) with weights, and their intercept."""
        if view == "content":
            return np.bincount(self.rows, weights=w[self.buckets] * self.values, minlength=len(self.shape)) + self.shape @ w[N_WORDS:-1] + w[-1]
        return (w[self.names].sum(axis=1) if view == "names" else self.bits @ w[:-1]) + w[-1]

    def dense(self, view: str) -> np.ndarray:
        n = len(self.shape)
        if view == "bits":
            return self.bits
        if view == "names":
            return np.stack([np.bincount(x, minlength=N_METADATA) for x in self.names]).astype(np.float32) if n else np.empty((0, N_METADATA), np.float32)
        out = np.zeros((n, N_CONTENT), dtype=np.float32)
        out[self.rows, self.buckets] = self.values
        out[:, N_WORDS:] = self.shape
        return out


def feature_table(docs: DataFrame, words: list[str]) -> DataFrame:
    """TABLE: the features of each row, and h, a hash of them."""
    number, schema = {w: k for k, w in enumerate(words)}, pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), *((c, pa.binary()) for c in ("words", "shape", "names", "bits"))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                texts = part["text"].to_pylist()
                columns = [*own.content(texts), [own.names(x, s, len(t)) for x, s, t in zip(part["lang"].to_pylist(), part["source"].to_pylist(), texts, strict=True)], presence(texts, number)]
                h = np.array([xxhash.xxh3_64_intdigest(b"".join(x)) for x in zip(*columns, strict=True)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(h), *(pa.array(c, pa.binary()) for c in columns)], schema=schema)

    return _source(docs).mapInArrow(features, TABLE)


def _source(docs: DataFrame) -> DataFrame:
    name = lambda c: column(c).cast("string").alias(c)
    return docs.select(column("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), name("lang"), name("source"))


# models


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = L2, steps: int = 150, rate: float = 0.5, start: np.ndarray | None = None) -> np.ndarray:
    """Weights with the intercept last, by full-batch Adam steps from start (or 0), in single precision; deterministic."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y, weight = y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    w, m, v = np.zeros(x.shape[1], np.float32) if start is None else start.astype(np.float32), 0.0, 0.0
    for t in range(1, steps + 1):
        g = (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) @ x + np.float32(l2) * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - np.float32(rate / (1 + t / 30)) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.99**t)) + np.float32(1e-6))
    return w


@dataclass
class Target:
    """What is learnt of one label: two views' weights, their calibration (slope, intercept), and the prior's log odds."""

    views: tuple[str, str]
    weights: list[np.ndarray] = field(default_factory=list)
    calibration: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0), (0.0, 0.0)])
    prior: float = 0.0

    def odds(self, i: int, x: Views) -> np.ndarray:
        """Calibrated log odds of view i; the prior's where nothing was learnt."""
        slope, base = self.calibration[i]
        return slope * x.margin(self.views[i], self.weights[i]) + base if self.weights else np.full(len(x.shape), self.prior)

    def whole(self, x: Views) -> np.ndarray:
        """Log odds of both views together."""
        return self.odds(0, x) + self.odds(1, x) - self.prior


class CoTraining:
    """One target's rounds: fit() both views, wanted() tells how many rows each may label, give() hands those to the other view."""

    def __init__(self, views: tuple[str, str], x: Views, y: np.ndarray, held: np.ndarray, l2: float, per_round: int):
        self.target, self.y, self.l2, self.per_round = Target(views), y, l2, per_round
        self.x = [x.dense(v) for v in views]
        known, self.held = y >= 0, held & (y >= 0)
        self.own = known & ~held
        good = float((y[known] == 1).mean()) if known.any() else 0.5
        self.good, self.target.prior = good, float(np.log((good * known.sum() + 1) / ((1 - good) * known.sum() + 1)))
        self.target.calibration = [(0.0, self.target.prior)] * 2
        self.extra: list[tuple[np.ndarray, np.ndarray]] = [(np.empty((0, v.shape[1]), np.float32), np.empty(0)) for v in self.x]
        self.given: list[set[int]] = [set(), set()]
        self.learns = all(len({*y[m].tolist()}) == 2 for m in (self.own, self.held))

    def fit(self) -> None:
        if not self.learns:
            return
        start = self.target.weights or [None, None]
        self.target.weights = [
            logistic(np.vstack([x[self.own], more]), np.concatenate([self.y[self.own], labels]), np.concatenate([np.ones(self.own.sum()), np.full(len(labels), 0.5)]), self.l2, 150 if w is None else 60, start=w)
            for x, (more, labels), w in zip(self.x, self.extra, start, strict=True)
        ]
        self.calibrate()

    def calibrate(self) -> None:
        for i in (0, 1):
            m = (self.x[i][self.held] @ self.target.weights[i][:-1] + self.target.weights[i][-1])[:, None]
            slope, base = logistic(m, self.y[self.held], np.ones(self.held.sum()), l2=1e-2, steps=300, rate=0.2)
            self.target.calibration[i] = (max(0.0, float(slope)), float(base))

    def held_loss(self) -> float:
        """Mean log loss over the rows held out."""
        z = sum(s * (x[self.held] @ w[:-1] + w[-1]) + b for x, w, (s, b) in zip(self.x, self.target.weights, self.target.calibration, strict=True)) - self.target.prior
        z = np.clip(z, -30, 30)
        return float(np.mean(np.log1p(np.exp(z)) - self.y[self.held] * z))

    def wanted(self, label: int) -> int:
        return int(self.per_round * (self.good if label else 1 - self.good))

    def give(self, i: int, x: Views, hashes: list[int], label: int) -> None:
        """Rows that view i has labelled, to the other view."""
        more, labels = self.extra[1 - i]
        self.extra[1 - i] = np.vstack([more, x.dense(self.target.views[1 - i])]), np.concatenate([labels, np.full(len(hashes), float(label))])
        self.given[i].update(hashes)


@dataclass
class Model:
    quality: Target
    toxic: Target
    words: list[str]


# training on all rows


def sample_ids(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, quality and toxic of at most max_labelled labelled ids, those of least hash."""
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where("quality is not null or toxic is not null")
    ids = docs.select(column("doc_id").cast("long").alias("id")).where("id is not null").distinct()
    return marked.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_labelled)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, lang, source, quality, toxic: one row for each of sample_ids(), stored."""
    sample = F.broadcast(sample_ids(docs, labels, max_labelled))
    own = F.struct(F.xxhash64("text", "lang", "source").alias("order"), "text", "lang", "source")
    one = _source(docs).join(sample, F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min(own).alias("x"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    return written(one.select("doc_id", "x.text", "x.lang", "x.source", "quality", "toxic"))


def is_held(doc_id: int) -> bool:
    """Whether a labelled row is kept for calibration."""
    return xxhash.xxh3_64_intdigest(str(doc_id)) % HELD_OUT == 0


def toxic_words(sample: DataFrame) -> list[str]:
    """The N_TOXIC words of LEAST_HOLDERS rows or more whose occurrence has the greatest likelihood ratio against toxic."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, toxic in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                if not is_held(i):
                    words = ["", *words_of(t)]  # "" counts the rows
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([int(toxic > 0)] * len(words), pa.int32())], ["word", "toxic"])

    counts = written(sample.where("toxic is not null").select("doc_id", "text", "toxic").mapInArrow(each, "word string, toxic int").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")))
    total = counts.where("word = ''").first()
    if not total or not 0 < total["t"] < total["n"]:
        discard(counts)
        return []
    n, t, all_, toxic = F.col("n"), F.col("t"), F.lit(total["n"]), F.lit(total["t"])
    h = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    ratio = h(t) + h(n - t) + h(toxic - t) + h(all_ - toxic - n + t) - h(n) - h(all_ - n)
    top = counts.where((n >= LEAST_HOLDERS) & (F.col("word") != "")).orderBy(F.round(ratio, 6).desc(), "word").limit(N_TOXIC)
    out = [r["word"] for r in top.select("word").collect()]
    discard(counts)
    return out


def surest(table: DataFrame, runs: list[CoTraining], sampled: frozenset[int]) -> dict[tuple[int, int, int], list[int]]:
    """By (run, view, label), the feature hashes of the rows not sampled that the view is surest of: over all rows, equal features once,
    those it gave before left out. Tasks keep that many candidates a list; MERGERS tasks merge them before the driver does."""
    lists = {(r, i, y): runs[r].wanted(y) for r in range(len(runs)) if runs[r].learns for i in (0, 1) for y in (0, 1)}
    models, given = [run.target for run in runs], [run.given for run in runs]
    schema = pa.schema([("r", pa.int32()), ("i", pa.int32()), ("y", pa.int32()), ("sure", pa.float64()), ("h", pa.int64())])

    def best(found: dict[tuple[int, int, int], dict[int, float]]) -> None:
        for k, n in lists.items():
            if len(found[k]) > n:
                found[k] = dict(sorted(found[k].items(), key=lambda x: (-x[1], x[0]))[:n])

    def rows(found: dict[tuple[int, int, int], dict[int, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"r": k[0], "i": k[1], "y": k[2], "sure": s, "h": h} for k, own in found.items() for h, s in own.items()], schema=schema)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: {} for k in lists}
        for b in batches:
            x, hashes = Views.of(b), b["h"].to_numpy()
            free = np.array([i not in sampled for i in b["doc_id"].to_pylist()], dtype=bool)
            for (r, i, y), n in lists.items():
                m = models[r].weights[i]
                m = x.margin(models[r].views[i], m) * (1 if y else -1)
                at = np.flatnonzero(free & (m > SURE))
                for k in at:
                    h = int(hashes[k])
                    if h not in given[r][i]:
                        found[r, i, y][h] = float(m[k])
                if len(found[r, i, y]) > 4 * n + 64:
                    best(found)
        best(found)
        yield rows(found)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: {} for k in lists}
        for b in batches:
            for x in b.to_pylist():
                found[x["r"], x["i"], x["y"]][x["h"]] = x["sure"]
            best(found)
        yield rows(found)

    if not lists:
        return {}
    kind = "r int, i int, y int, sure double, h long"
    near = table.mapInArrow(candidates, kind).repartition(MERGERS, "h").mapInArrow(merged, kind).toArrow().to_pylist()
    found: dict[tuple[int, int, int], dict[int, float]] = {k: {} for k in lists}
    for x in near:
        found[x["r"], x["i"], x["y"]][x["h"]] = x["sure"]
    best(found)
    return {k: sorted(own) for k, own in found.items()}


def train(table: DataFrame, sample: DataFrame, words: list[str], rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """A model from the labelled sample and rounds over the whole feature table (stored)."""
    spark = table.sparkSession
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in sample.select("doc_id", "quality", "toxic").collect()}  # at most MAX_LABELLED
    own = feature_table(sample, words).toArrow().sort_by("doc_id")
    ids = own["doc_id"].to_pylist()
    x, held = Views.of(own), np.array([is_held(i) for i in ids], dtype=bool)
    y = [np.array([-1 if labels[i][k] is None else int(labels[i][k] > 0) for i in ids], dtype=int) for k in (0, 1)]
    runs = [CoTraining(("content", "names"), x, y[0], held, L2, per_round), CoTraining(("bits", "names"), x, y[1], held, TOXIC_L2, per_round)]
    alone: tuple[float, Target] | None = None
    for turn in range(rounds + 1):
        for run in runs:
            run.fit()
        if turn == 0 and runs[1].learns:
            alone = runs[1].held_loss(), Target(runs[1].target.views, list(runs[1].target.weights), list(runs[1].target.calibration), runs[1].target.prior)
        if turn == rounds:
            break
        picked = surest(table, runs, frozenset(ids))
        hashes = sorted({h for own_ in picked.values() for h in own_})
        if not hashes:
            break
        chosen = F.broadcast(spark.createDataFrame([(h,) for h in hashes], "h long"))  # at most 2 * 2 * per_round
        rows = table.join(chosen, "h").dropDuplicates(["h"]).toArrow()
        place = {h: k for k, h in enumerate(rows["h"].to_pylist())}
        for (r, i, label), own_ in picked.items():
            if own_:
                runs[r].give(i, Views.of(rows.take([place[h] for h in own_])), own_, label)
    if alone and alone[0] < runs[1].held_loss():
        runs[1].target = alone[1]
    return Model(runs[0].target, runs[1].target, words)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **how) -> Model:
    sample = labelled_sample(docs, labels, max_labelled)
    words = toxic_words(sample)
    table = written(feature_table(docs, words))
    model = train(table, sample, words, **how)
    discard(sample, table)
    return model


def score_features(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_content, p_metadata, score and kept (score of at least 0.5), p_toxic and toxic (p_toxic above 0.5) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("p_content", pa.float64()), ("p_metadata", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for b in batches:
            for at in range(0, b.num_rows, 4 * ROWS_AT_ONCE):
                part = b.slice(at, 4 * ROWS_AT_ONCE)
                x = Views.of(part)
                whole, toxic = p(model.quality.whole(x)), p(model.toxic.whole(x))
                columns = [p(model.quality.odds(0, x)), p(model.quality.odds(1, x)), whole, whole >= 0.5, toxic, toxic > 0.5]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return table.mapInArrow(scored, "doc_id long, p_content double, p_metadata double, score double, kept boolean, p_toxic double, toxic boolean")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """score_features() of any documents."""
    return score_features(feature_table(docs, model.words), model)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sample = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    words = toxic_words(sample)
    table = written(feature_table(docs, words))
    model = train(table, sample, words)
    discard(sample)
    return score_features(table, model)
