"""Toxicity by class-conditional Kneser-Ney models.

Two models of the symbols (bytes) of texts, one of toxic and one of ordinary texts, have their own
counts where a context is longest and back off to shared continuation counts of both, so that rare
expressions, and new forms of known ones, are smoothed alike by either. A text is a stream of its
lower-cased words with one space between, and grams run over the spaces, so that expressions of
several words are counted as such. What decides is the difference of the two log-likelihoods by
length: over the whole text, and over its likeliest passages of ``PASSAGES`` symbols, since few
words make a long text toxic. A logistic calibration, fitted to texts that the scoring model has
not seen, turns these length-normalised differences into a score.

The models count all training labels' texts, and the shared continuations those of all
documents, in tables of grams built by Spark. Only the calibration is fitted to at most
``per_class`` labelled texts of each class, chosen by hash and weighed so that the classes keep
their shares of all training labels. Every text is scored whole, in pieces of bounded size that
carry their context along, by the grams' evidence: broadcast at once if small, in pieces if not.

Cases: null or empty text has no evidence and gets the score of none; a text shorter than a
passage is one; without labels of both classes every score is 0; repeated or null ids are scored
like others, but a null id carries no label; if labels repeat an id, toxic wins; an empty table
gives no rows. Other columns are ignored (``scored`` passes them on).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_bytes, ceil_div, chunks_by_bytes, cut, released

#: Symbols in a gram, discount, weight of the shared backoff in a class's contexts, calibration texts of each class.
ORDER, DISCOUNT, STRENGTH, PER_CLASS = 6, 0.75, 10.0, 3000
#: First symbols of a word that are predicted from the word before, too.
CROSSING = 2
#: Symbols of the passages whose likelihoods are compared, bytes looked at at once, grams looked at before they are
#: counted, and held before they are handed on.
PASSAGES, PIECE, NEW, HELD = (8, 24), 1 << 18, 1 << 19, 1 << 21
#: Evidence of up to so many grams is broadcast at once, more in pieces of so many (``LEAST`` at least), which each stretch
#: of so many bytes of text looks into. Up to so many labels are broadcast; more are joined.
BROADCAST_GRAMS, LEAST, STRETCH = 2_000_000, 1 << 16, 1 << 22
#: Grams of less evidence than this say nothing and are not kept.
SILENT = 0.02
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[SPACE] = 32


class Model(NamedTuple):
    """Evidence of grams, the calibration's weights (constant first), and the most grams to broadcast."""

    evidence: DataFrame
    weights: np.ndarray
    most: int


def symbols(text: bytes) -> np.ndarray:
    """The text's symbols: its lower-cased words, a space before each and after the last."""
    b = LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    space = b == 32
    return b[~(space & np.concatenate(([False], space[:-1])))]


def longest_grams(b: np.ndarray) -> np.ndarray:
    """For each symbol but the first, it and up to ``ORDER - 1`` before it, a byte each; their number above 48 bits.

    The first ``CROSSING`` symbols of a word see the word before; the later ones see no farther
    than the space before their own word, so that a word is known in whatever company it comes.
    """
    wide, at = b.astype(np.int64), np.arange(1, len(b))
    space = np.maximum.accumulate(np.where(b[:-1] == 32, at - 1, 0))  # the last space before each symbol
    length = np.where(at - space > CROSSING, at - space, at)
    length = np.minimum(length, ORDER - 1)
    gram = wide[1:] | (length << 48)
    for k in range(1, min(ORDER, len(b))):
        gram[k - 1 :] |= np.where(length[k - 1 :] >= k, wide[: len(wide) - k], 0) << (8 * k)
    return gram


def text_grams(text: bytes) -> Iterator[np.ndarray]:
    """All grams of a text, in pieces of about ``PIECE`` symbols that overlap by a gram's context."""
    b = symbols(text)
    if len(b) > 1:
        for at in range(0, len(b) - 1, PIECE):
            lead = min(at, ORDER)
            yield longest_grams(b[at - lead : at + PIECE + 1])[lead:]


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with sums of the rows of ``counts``."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.stack([np.add.reduceat(c[order], begin, dtype=np.int32) if len(begin) else np.zeros(0, np.int32) for c in counts])


def gram_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``gram`` (longest grams of all documents) and ``n0`` to ``n3``: counts in the training labels' texts, by fold and class."""
    cells = cut(training(labels).select("doc_id", (2 * F.col("fold") + F.col("y")).alias("cell")))
    if cells.count() <= BROADCAST_GRAMS:
        cells = F.broadcast(cells)  # texts stay where they lie
    rows = docs.select("doc_id", "text").join(cells, "doc_id", "left").select("text", F.coalesce("cell", F.lit(4)).alias("cell"))
    names = ["gram", *(f"n{k}" for k in range(4))]

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: list[tuple[np.ndarray, int]] = []
        runs: list[tuple[np.ndarray, np.ndarray]] = []  # sorted grams with counts
        size = 0

        def fold() -> None:
            """The new grams as one more run; runs are merged once they are as many as the first one's grams."""
            cell = np.repeat(np.array([c for _, c in new], np.int8), [len(g) for g, _ in new])
            runs.append(_sums(np.concatenate([g for g, _ in new]), [cell == c for c in range(4)]))
            new.clear()
            if len(runs) > 1 and sum(len(g) for g, _ in runs[1:]) > max(len(runs[0][0]), NEW):
                runs[:] = [_sums(np.concatenate([g for g, _ in runs]), np.concatenate([n for _, n in runs], axis=1))]

        def batch_of() -> pa.RecordBatch:
            gram, n = _sums(np.concatenate([g for g, _ in runs]), np.concatenate([n for _, n in runs], axis=1))
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array(gram), *(pa.array(x, pa.int64()) for x in n)], names=names)

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for text, cell in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    for grams in text_grams(text):
                        new.append((grams, cell))
                        size += len(grams)
                        if size > NEW:
                            fold()
                            size = 0
                            if sum(len(g) for g, _ in runs) > HELD:
                                yield batch_of()
        if new:
            fold()
        if runs:
            yield batch_of()

    return rows.mapInArrow(task, ", ".join(f"{n} long" for n in names)).groupBy("gram").agg(*[F.sum(n).alias(n) for n in names[1:]])


def gram_evidence(grams: DataFrame) -> DataFrame:
    """``gram, half0, half1, whole``: log-likelihood differences of the longest grams, by the models of either fold and of both."""
    length = F.shiftright("gram", 48)
    suffix, context = (F.expr(f"((gram >> 48) - {less} << 48) | {rest}") for less, rest in ((1, "(gram & ((1L << int(8 * (gram >> 48))) - 1))"), (0, "((gram & ((1L << 48) - 1)) >> 8)")))
    grams = grams.withColumn("length", length).withColumn("suffix", suffix).withColumn("context", context)
    shorter = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("length")
    shared = grams.select("gram", shorter).select(F.expr("(length << 48) | (gram & ((1L << int(8 * (length + 1))) - 1))").alias("gram")).distinct()
    shared = cut(shared.withColumn("length", length).withColumn("suffix", suffix).withColumn("context", context))
    longer = shared.where("length > 0").select("gram", "suffix").union(grams.select("gram", "suffix")).distinct()
    continued = longer.groupBy(F.col("suffix").alias("gram")).agg(F.count("*").alias("after"))
    shared = shared.join(continued, "gram")
    shared = cut(shared.join(shared.groupBy("context").agg(F.sum("after").alias("total"), F.count("*").alias("types")), "context"))
    lower, levels = None, []
    for length in range(ORDER - 1):
        level = shared.where(F.col("length") == length)
        level = level.withColumn("back", F.lit(1 / 256)) if lower is None else level.join(lower, "suffix")
        p = (F.greatest(F.col("after") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("back")) / F.col("total")
        level = cut(level.select("gram", p.alias("p")))
        levels.append(level)
        lower = level.select(F.col("gram").alias("suffix"), F.col("p").alias("back"))
    back = reduce(DataFrame.union, levels).select(F.col("gram").alias("suffix"), "p")
    models = {"half0": ("n0", "n1"), "half1": ("n2", "n3"), "whole": ("n0 + n2", "n1 + n3")}
    n = {(m, y): F.expr(e) for m, pair in models.items() for y, e in enumerate(pair)}
    sums = [x for (m, y), c in n.items() for x in (F.sum(c).alias(f"{m}_t{y}"), F.sum((c > 0).cast("long")).alias(f"{m}_k{y}"))]
    contexts = grams.where("n0 + n1 + n2 + n3 > 0").groupBy("context").agg(*sums)

    def likelihood(m: str, y: int) -> Column:
        t, k = F.col(f"{m}_t{y}"), F.col(f"{m}_k{y}")
        return (F.greatest(n[m, y] - DISCOUNT, F.lit(0.0)) + (STRENGTH + DISCOUNT * k) * F.col("p")) / (STRENGTH + t)

    known = grams.join(contexts, "context").join(back, "suffix")  # of other contexts both models say the same
    said = known.select("gram", *[F.log(likelihood(m, 1) / likelihood(m, 0)).alias(m) for m in models])
    return said.where(reduce(Column.__or__, [F.abs(m) >= SILENT for m in models]))


class Table:
    """Evidence by gram in an open-addressed array: two reads for most symbols."""

    def __init__(self, grams: np.ndarray, evidence: np.ndarray):
        self.bits = max(8, int(2 * len(grams) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        left, at = np.arange(len(grams)), self._home(grams)
        while len(left):  # each round one gram takes each free place, the others go on to the next
            free = self.keys[at] == -1
            self.keys[at[free]] = grams[left[free]]
            won = self.keys[at] == grams[left]
            self.values[at[won]] = evidence[left[won]]
            left, at = left[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self._home(grams)
        out = np.where(self.keys[at] == grams, self.values[at], np.float32(0))
        left = np.flatnonzero((self.keys[at] != grams) & (self.keys[at] != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == grams[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (self.keys[at] != -1)
            left, at = left[on], at[on]
        return out


def passages(evidence: np.ndarray, width: int) -> float:
    """The largest mean over ``width`` consecutive symbols (over all, if there are fewer)."""
    if len(evidence) <= width:
        return float(evidence.mean()) if len(evidence) else 0.0
    total = np.cumsum(np.concatenate(([0.0], evidence)))
    return float((total[width:] - total[:-width]).max() / width)


def features_of(pieces: Iterable[np.ndarray], table: Table) -> list[float]:
    """Length-normalised differences of the log-likelihoods: of a whole text, and of its likeliest passage of each width."""
    n, total, best, tail = 0, 0.0, [-math.inf] * len(PASSAGES), np.zeros(0, np.float32)
    for grams in pieces:
        e = table(grams)
        n, total = n + len(e), total + float(e.sum(dtype=np.float64))
        run = np.concatenate((tail, e))  # passages may begin in the piece before
        best = [max(b, passages(run, w)) for b, w in zip(best, PASSAGES, strict=True)]
        tail = run[-max(PASSAGES) :]
    return [total / n, *best] if n else [0.0] * (1 + len(PASSAGES))


def text_features(text: bytes, table: Table) -> list[float]:
    return features_of(text_grams(text), table)


FEATURES = ("_of_all", *[f"_of_{w}" for w in PASSAGES])


def with_features(docs: DataFrame, evidence: DataFrame, model: str, most: int = BROADCAST_GRAMS) -> DataFrame:
    """``docs`` with ``FEATURES``: by one broadcast of up to ``most`` grams' evidence, or by several, if there are more. The results are the same."""
    evidence, count = evidence.select("gram", F.col(model).cast("float").alias("e")), evidence.count()
    return _broadcast_features(docs, evidence) if count <= most else _pieced_features(docs, evidence, ceil_div(count, max(most, LEAST)))


def _shipped(evidence: DataFrame) -> Broadcast:
    """A piece of the evidence, by gram."""
    got = evidence.toArrow()  # about ``most`` rows
    grams, e = got.column("gram").to_numpy(), got.column("e").to_numpy()
    order = np.argsort(grams)
    return evidence.sparkSession.sparkContext.broadcast((grams[order], e[order]))


def _broadcast_features(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    shipped, at = _shipped(evidence), docs.columns.index("text")

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shipped.value)
        for batch in batches:
            parts = (batch.column(at).slice(k, 500) for k in range(0, batch.num_rows, 500))
            yield _with_columns(batch, [text_features(t, table) for part in parts for t in as_bytes(part)])

    return docs.mapInArrow(task, _with_feature_fields(docs))


def _with_columns(batch: pa.RecordBatch, rows: list[list[float]]) -> pa.RecordBatch:
    for name, column in zip(FEATURES, np.array(rows).reshape(-1, len(FEATURES)).T, strict=True):
        batch = batch.append_column(name, pa.array(column))
    return batch


def _with_feature_fields(docs: DataFrame) -> StructType:
    return StructType([*docs.schema.fields, *[StructField(n, DoubleType()) for n in FEATURES]])


def distinct(grams: list[np.ndarray]) -> np.ndarray:
    g = np.sort(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
    return g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) else g


def _pieced_features(docs: DataFrame, evidence: DataFrame, pieces: int) -> DataFrame:
    """Texts stay where they lie. Those of a stretch of rows look their distinct grams up in each piece of the evidence, and are scored by what they found.

    Neither a symbol nor a text is shuffled. A piece at a time passes the driver; a worker holds them as sorted arrays, 12 bytes a gram.
    """
    piece, at = F.pmod(F.xxhash64("gram"), F.lit(pieces)), docs.columns.index("text")
    shipped = [_shipped(evidence.where(piece == k)) for k in range(pieces)]

    def table_of(own: np.ndarray) -> Table:
        said = np.zeros(len(own), np.float32)
        for x in shipped:
            grams, e = x.value
            if len(grams):
                where = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                hit = grams[where] == own
                said[hit] = e[where[hit]]
        return Table(own[said != 0], said[said != 0])

    def scored_stretch(texts: list[bytes]) -> list[list[float]]:
        if len(texts) == 1:  # perhaps a very long one: its grams are made twice, and never held all at once
            held: list[np.ndarray] = []
            for grams in text_grams(texts[0]):
                held.append(grams)
                if sum(map(len, held)) > STRETCH:
                    held = [distinct(held)]
            table = table_of(distinct(held))
            return [text_features(texts[0], table)]
        grams = [list(text_grams(t)) for t in texts]
        table = table_of(distinct([g for own in grams for g in own]))
        return [features_of(own, table) for own in grams]

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(at))
            yield _with_columns(batch, [x for i, j in chunks_by_bytes(texts, STRETCH) for x in scored_stretch(texts[i:j])])

    return docs.mapInArrow(task, _with_feature_fields(docs))


def calibrate(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 0.001) -> np.ndarray:
    """Logistic weights (constant first) by Newton steps on a ridge-penalised likelihood; each row stands for ``rows`` like it."""
    a = np.column_stack((np.ones(len(x)), x))
    weight = rows / rows.sum()
    scale = np.maximum(np.sqrt(weight @ (a - weight @ a) ** 2), 1e-9)
    scale[0] = 1
    a, w = a / scale, np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.diag([1e-6] + [1] * (len(w) - 1)), a.T @ (weight * (y - p)) - ridge * np.r_[0, w[1:]])
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training(labels: DataFrame) -> DataFrame:
    """``doc_id, y, fold`` of the labels to learn from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~is_held_out())
    return known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``text, y, fold`` of the calibration texts."""
    known, order = training(labels), F.xxhash64("doc_id", F.lit("learn"))
    few = known.where("y = 1").orderBy(order, "doc_id").limit(per_class).union(known.where("y = 0").orderBy(order, "doc_id").limit(per_class))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y", "fold")  # at most twice per_class labels


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = BROADCAST_GRAMS) -> Model | None:
    """Evidence by the models of all training texts, and the weights that fit texts scored by models of the other half."""
    grams = cut(gram_counts(docs, labels))
    cells = [n or 0 for n in grams.agg(*[F.sum(f"n{k}") for k in range(4)]).first()]
    if not (cells[0] + cells[2] and cells[1] + cells[3]):
        return None
    apart = all(cells)  # else a half lacks a class, and texts are scored by the models of both halves
    evidence = cut(gram_evidence(grams))
    sample = cut(_sample(docs, labels, per_class))
    got = pa.concat_tables([with_features(sample.where(F.col("fold") == fold), evidence, f"half{1 - fold}" if apart else "whole", most).select("y", *FEATURES).toArrow() for fold in (0, 1)])
    x, y = np.column_stack([got.column(c).to_numpy() for c in FEATURES]), got.column("y").to_numpy()
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], y))  # sums do not depend on the order in which rows came
    all_rows, few_rows = (dict(d.groupBy("y").count().collect()) for d in (docs.select("doc_id").join(training(labels), "doc_id"), sample))
    stands_for = np.array([all_rows[c] / few_rows[c] for c in (0, 1)])  # the prior is that of all training labels
    return Model(evidence, calibrate(x[order], y[order], stands_for[y[order]]), most)


def scored(docs: DataFrame, model: Model | None, score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row's ``text``."""
    if model is None:
        return docs.withColumn(score, F.lit(0.0))
    z = sum((F.col(c) * float(w) for c, w in zip(FEATURES, model.weights[1:], strict=True)), F.lit(float(model.weights[0])))
    rows = with_features(docs, model.evidence, "whole", model.most)
    return rows.select(*docs.columns, (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias(score))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id``, ``text``)."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels, per_class))
    return rows.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
