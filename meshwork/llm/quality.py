"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meshwork.llm.scratch import small_batches
from meshwork.llm.textbytes import ALNUM, LOWER, U, blocks, range_codes, words

#: Words count whole and, if longer, by their first STEM bytes. 2^BITS weights for them, then one for each ASCII character that is neither lower case nor digit, then the share of words that repeat.
BITS, STEM = 18, 5
N_WORDS = 1 << BITS
N_ALL = N_WORDS + 128 + 1
#: The bounds of the sample that the model is fitted on: texts, and the bytes of one. Longer rated texts aren't learnt from; all texts are scored whole.
TRAIN_ROWS, TRAIN_BYTES = 8000, 1 << 18


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, feature numbers and values: 1 for each distinct hashed word and stem; square roots of characters' shares; the share of repeated words."""
    low = LOWER[data]
    start, end, first = words(low, off, ALNUM)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    long_ = end - start > STEM
    stem = range_codes(low, start[long_], start[long_] + STEM, 32)  # another place than the word of these letters
    code = np.concatenate([range_codes(low, start, end, 31), stem]) >> U(64 - BITS)
    both = np.sort(np.concatenate([row, row[long_]]) * N_WORDS + code.astype(np.int64))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    r1, f1 = both // N_WORDS, both % N_WORDS
    size, count = np.diff(off), np.diff(first)
    text = np.repeat(np.arange(n), size)
    odd = (data < 128) & ~((data >= 97) & (data <= 122)) & ~((data >= 48) & (data <= 57)) & (data != 32)
    shares = np.bincount(text[odd] * 128 + data[odd], minlength=n * 128).reshape(n, 128)
    r2, f2 = np.nonzero(shares)
    v2 = 4 * np.sqrt(shares[r2, f2] / size[r2])
    many = np.flatnonzero(count)
    whole = np.bincount(r1, minlength=n)[many] / (count + np.bincount(row[long_], minlength=n))[many]
    v3 = 1 - whole
    return np.concatenate([r1, r2, many]), np.concatenate([f1, f2 + N_WORDS, np.full(len(many), N_ALL - 1)]), np.concatenate([np.ones(len(r1)), v2, v3])


def candidates(number: np.ndarray, n: int) -> np.ndarray:
    """Which features may be learnt from n texts: characters' shares, and words of 8 texts or more (rare ones would be learnt by heart) but not of
    every fifth or more (long texts hold them all, whatever their grade)."""
    found = np.bincount(number, minlength=N_ALL)
    found[N_WORDS:] = 8
    return (found >= 8) & ((found <= n / 5) | (np.arange(N_ALL) >= N_WORDS))


def summed(index: np.ndarray, weight, size: int, step: int = 1 << 18) -> np.ndarray:
    """Sums by index of weight(slice), a part at a time, so that nothing as long as the index is held in doubles."""
    out = np.zeros(size)
    for lo in range(0, len(index), step):
        own = slice(lo, lo + step)
        out += np.bincount(index[own], weight(own), size)
    return out


class Ordinal:
    """P(grade <= j) = logistic(theta_j - x.w): weights shared by all grades, thresholds in order (theta_0, then positive steps)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j, columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def scores(self, row, number, value, n: int) -> np.ndarray:
        return summed(row, lambda own: self.weights[number[own]] * value[own], n)

    @classmethod
    def fit(cls, row, number, value, grade, l2: float = 1e-4, steps: int = 150, rate: float = 0.2, least: float = 5.0, most_rounds: int = 12) -> Ordinal:
        """Maximum likelihood over features that earn their place. It begins with the characters' shares; each round fits, then adds the words whose
        gradient at the fitted model is far from chance (z >= least, and half of the largest); so words that only go along with
        others (of one language, say) stay out. A word can only count against a text, else long ones would earn credit by their length."""
        n, cuts = len(grade), max(1, int(grade.max(initial=1)))
        model = cls(np.zeros(N_ALL), np.arange(cuts) - float(cuts))
        active, may = np.zeros(N_ALL, bool), candidates(number, n)
        active[N_WORDS:] = True
        for _ in range(most_rounds):
            on = active[number]
            model = cls._fitted(model, row[on], number[on], value[on], grade, l2, steps, rate)
            slope = model._slopes(model.scores(row, number, value, n), grade)[0]
            sums = summed(number, lambda own, slope=slope: slope[row[own]] * value[own], N_ALL)
            spread = summed(number, lambda own: value[own] * value[own], N_ALL) * (slope * slope).mean()
            z = sums / np.sqrt(np.maximum(spread, 1e-12))
            z[active | ~may] = 0
            if z.max() < least:
                break
            active |= z >= max(least, z.max() / 2)
        return cls(model.weights.astype(np.float32), model.thresholds)

    def _slopes(self, score: np.ndarray, grade: np.ndarray):
        """Derivatives of each row's loss by its score, and by the thresholds above and below its grade."""
        n = len(grade)
        below = 1 - self.above(score)
        full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        hi, lo = full[np.arange(n), grade + 1], full[np.arange(n), grade]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        return d_hi - d_lo, d_hi, d_lo

    @classmethod
    def _fitted(cls, model: Ordinal, row, number, value, grade, l2: float, steps: int, rate: float) -> Ordinal:
        """From a model on, by Adam over all rows at once."""
        n = len(grade)
        used, number = np.unique(number, return_inverse=True)
        words = used < N_WORDS
        w = np.asarray(model.weights, np.float64)[used].copy()
        cuts = len(model.thresholds)
        # the first threshold, and the logarithms of the steps between them, so they stay in order
        theta = np.concatenate([model.thresholds[:1], np.log(np.maximum(1e-3, np.diff(model.thresholds)))])
        ordered = lambda x: np.cumsum(np.concatenate([x[:1], np.exp(x[1:])]))
        m1 = v1 = np.zeros(len(used))
        m2 = v2 = np.zeros(cuts)
        for t in range(1, steps + 1):
            now = cls(w, ordered(theta))
            d_s, d_hi, d_lo = (x / n for x in now._slopes(np.bincount(row, w[number] * value, n), grade))
            g = np.bincount(number, d_s[row] * value, len(used)) + l2 * w
            by_cut = np.array([(-d_hi[grade == j]).sum() + d_lo[grade == j + 1].sum() for j in range(cuts)])
            behind = by_cut[::-1].cumsum()[::-1]  # a step moves all thresholds behind it
            g2 = np.concatenate([behind[:1], behind[1:] * np.exp(theta[1:])])
            step = rate * (1 - t / (steps + 1))
            m1, v1 = 0.9 * m1 + 0.1 * g, 0.99 * v1 + 0.01 * g * g
            m2, v2 = 0.9 * m2 + 0.1 * g2, 0.99 * v2 + 0.01 * g2 * g2
            fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            w = w - step * fix * m1 / (np.sqrt(v1) + 1e-8)
            w[words] = np.minimum(w[words], 0)
            theta = theta - step * fix * m2 / (np.sqrt(v2) + 1e-8)
        full_w = np.zeros(N_ALL)
        full_w[used] = w
        return cls(full_w, ordered(theta))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null without either rating. Toxic is the lowest: however many insults a text has, its score may fall."""
    return F.when(toxic > 0, 0).when(quality <= 0, 1).when(F.coalesce(quality, toxic).isNotNull(), 2)


def fit(docs: DataFrame, ratings: DataFrame, text: str = "text", doc_id: str = "doc_id", grade: str = "grade", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Ordinal | None:
    """The model from at most `rows` rated texts of at most `most_bytes` each, those of the smallest hashes of the id; None if no text is rated. Grades are 0, 1, 2, ...
    up to the largest that occurs. Of several ratings of an id the lowest counts, of several texts of an id the first by SHA-256; ratings and texts without id, and negative grades, play no part."""
    small_batches(docs.sparkSession)
    rated = ratings.where((F.col(grade) >= 0) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(grade).cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    # as many rows as were chosen, so the sort and the text of one row an id stay small
    joined = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("grade").alias("grade"), F.min_by("text", F.sha2("text", 256)).alias("text")).select("text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column("text")):
                row, number, value = features(data, off)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    own = order[cut[i] : cut[i + 1]]
                    yield pa.RecordBatch.from_arrays([batch.column("grade").slice(lo + i, 1), pa.array([number[own].astype(np.int32).tobytes()], pa.binary()), pa.array([value[own].astype(np.float32).tobytes()], pa.binary())], names=["grade", "number", "value"])

    got = sorted(joined.mapInArrow(run, "grade int, number binary, value binary").collect())
    if not got:
        return None
    grades = np.array([r["grade"] for r in got])
    number = np.frombuffer(b"".join(r["number"] for r in got), np.int32)
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(r["number"]) // 4 for r in got])
    value = np.frombuffer(b"".join(r["value"] for r in got), np.float32)
    del got
    may = candidates(number, len(grades))[number]
    return Ordinal.fit(row[may], number[may], value[may], grades)


def classify(docs: DataFrame, model: Ordinal | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """Adds expected_grade (0 to the top grade), p_good (the tail probability of the top grade) and keep (p_good >= least).

    A null or empty text has no features, so the model's prior decides; without a model (no ratings) both figures are null and all is kept. Each row is judged by
    itself, repeated ones too, long texts whole; columns of these names are replaced, all others are kept, whatever their names; an empty table gives an empty result.
    """
    names = ["expected_grade", "p_good", "keep"]
    carried = [c for c in docs.columns if c not in names]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in carried], F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_good"), F.lit(True).alias("keep"))
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.weights, model.thresholds))  # N_ALL floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*sent.value)
        for batch in batches:
            tails = [own.above(own.scores(*features(data, off), hi - lo)) for lo, hi, data, off in blocks(batch.column(1))]
            p = np.concatenate(tails) if tails else np.zeros((0, len(own.thresholds)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= least)], names=["row", *names])

    # all columns travel in one struct, so that none can clash with the operator's own
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([whole.schema["row"], T.StructField("expected_grade", T.DoubleType()), T.StructField("p_good", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return whole.mapInArrow(run, schema).select("row.*", *names)
