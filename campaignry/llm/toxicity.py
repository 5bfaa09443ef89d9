"""Toxicity by a support vector machine over a subsequence kernel with Nyström landmarks.

The kernel of two words sums, over the subsequences of 3 and 4 characters that span at most SPAN, the products of their
weights, DECAY for each character spanned; so an insult with characters put in, or pulled apart by signs, still
shares most of them. Values are scaled by the lengths. Landmarks are words of labelled texts; features are the kernel with each landmark
times the inverse root of the landmarks' own kernel; on these a linear machine with squared hinge loss is trained. As the
kernel's features are explicit, the whole sum folds into one weight for each subsequence of the landmarks.

Training reads a bounded sample of labelled documents (MOST_TOXIC and MOST_CLEAN, chosen by hash). Their sentences carry the
label of the document; equal ones count once. Words that toxic sentences have far more often than chance allows
are positive, also with a character inserted; words of clean ones negative, at first chosen by hash, then those that the machine holds for
the most toxic. A text scores as its worst word; a logistic curve, fitted on the whole texts of the sample, turns that into a probability.

Words are the tokens between spaces, taken apart at signs and also without them (`i.d.i.o.t`), and runs of three or more single letters.

Edge cases: an empty or null text, or one without a letter, scores as the least margin; without labelled toxic and clean
texts all score 0; a very long text is handled in parts; repeated rows give a row each; a label that repeats counts as toxic if any is; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .ragged import Memo, grouped, pieces

LENGTHS, SPAN, DECAY = (3, 4), 6, 0.6
LANDMARKS = 256
MOST_TOXIC, MOST_CLEAN = 4000, 8000
#: Words that training takes: positive ones, negative ones chosen by hash, and hard ones in each round.
POSITIVE, NEGATIVE, HARD, ROUNDS = 1500, 4000, 2000, 2
PENALTY = 1e-3
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = r"[.!?\n]+"
CUT = re.compile(r"(?<=\w\w)\s(?=\w\w)")
#: Offsets of a subsequence's characters from its first.
PATTERNS = [(0, *p) for k in LENGTHS for p in itertools.combinations(range(1, SPAN), k - 1)]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(token: str) -> list[str]:
    """The words of a token: its runs of letters, and, if there are several, also all of them without what lies between."""
    runs = LETTERS.findall(token)
    return [*runs, "".join(runs)] if len(runs) > 1 else runs


def spaced(tokens: list[str]) -> list[str]:
    """Runs of three or more tokens of a single letter, joined."""
    single = np.fromiter((len(t) == 1 for t in tokens), bool, len(tokens))
    if single.sum() < 3:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
    return ["".join(tokens[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= 3 and all(LETTERS.match(t) for t in tokens[a:b])]


class Subsequences:
    """The explicit features of the kernel over an alphabet: codes of subsequences with weights."""

    def __init__(self, alphabet: str):
        self.alphabet = np.frombuffer("".join(sorted(set(alphabet) | set("^$"))).encode("utf-32-le"), np.uint32)
        self.size = len(self.alphabet) + 1  # 0 stands for all other characters

    def parts(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each pattern: numbers of words, codes of their subsequences, weight."""
        char = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, char), len(self.alphabet) - 1)
        place = np.where(self.alphabet[at] == char, at + 1, 0).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
        for pattern in PATTERNS:
            n = len(place) - pattern[-1]
            if n <= 0:
                continue
            inside = np.flatnonzero(owner[:n] == owner[pattern[-1] :])
            code = place[inside]
            known = code > 0
            for k in pattern[1:]:
                more = place[inside + k]
                code = code * self.size + more
                known &= more > 0
            code += self.size**4 * len(pattern)
            yield owner[inside[known]], code[known], DECAY ** (pattern[-1] + 1)

    @staticmethod
    def scale(words: list[str]) -> np.ndarray:
        """What a word's values are divided by: the root of its squared weights, as if no subsequence came twice."""
        n = np.fromiter(map(len, words), np.float64, len(words)) + 2
        return np.sqrt(sum(DECAY ** (2 * p[-1] + 2) * np.maximum(0, n - p[-1]) for p in PATTERNS) + 1e-9)

    def dense(self, words: list[str], codes: np.ndarray) -> np.ndarray:
        """Weights of the subsequences in codes (sorted), a row for each word."""
        out = np.zeros((len(words), len(codes)), np.float32)
        for owner, code, weight in self.parts(words):
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            np.add.at(out, (owner[hit], at[hit]), np.float32(weight))
        return out / self.scale(words)[:, None].astype(np.float32)


class Machine:
    """One weight for each subsequence of the landmarks, a shift, and the logistic curve's slope and middle."""

    def __init__(self, alphabet: str, codes: np.ndarray, weights: np.ndarray, shift: float):
        self.parts, self.codes, self.weights, self.shift = Subsequences(alphabet), codes, weights, shift
        self.slope, self.middle = 1.0, 0.0
        self.memo: Memo | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for owner, code, weight in self.parts.parts(words):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out += np.bincount(owner, np.where(self.codes[at] == code, self.weights[at], 0) * weight, len(words))
        return out / self.parts.scale(words) + self.shift

    def worst(self, tokens: list[str]) -> list[float]:
        """The margin of each token's worst word; -inf without a word."""
        split = [words_of(t) for t in tokens]
        flat = [w for s in split for w in s]
        best = np.full(len(tokens), -np.inf)
        if flat:
            np.maximum.at(best, np.repeat(np.arange(len(tokens)), [len(s) for s in split]), self.margins(flat))
        return best.tolist()

    def text_margins(self, texts: list[str | None]) -> np.ndarray:
        """The margin of each text's worst word; -inf without a word."""
        import pyarrow as pa

        if self.memo is None:
            self.memo = Memo(self.worst, most=150_000, chars=1 << 21)
        out = np.full(len(texts), -np.inf)
        flat, owner = [], []
        for i, text in enumerate(texts):
            for part in pieces((text or "").lower(), CUT):
                tokens = part.split()
                tokens += spaced(tokens)
                flat += tokens
                owner.append((i, len(tokens)))
        if flat:
            coded = pa.array(flat, pa.string()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            self.memo.provide(distinct)
            value = np.array(list(map(self.memo.__getitem__, distinct)))
            np.maximum.at(out, np.repeat([i for i, _ in owner], [n for _, n in owner]), value[coded.indices.to_numpy()])
        return out

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (np.maximum(margin, self.shift - 10) - self.middle), -40, 40)))


def fit_margin(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1).astype(np.float64)
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    loss = lambda v: PENALTY * (v[:-1] ** 2).sum() + (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    now = loss(w)
    for _ in range(30):
        near = y * (x @ w) < 1
        a = x[near] * weight[near, None]
        ridge = np.full(len(w), PENALTY)
        ridge[-1] = 1e-8
        step = np.linalg.solve(a.T @ x[near] + np.diag(ridge), a.T @ y[near]) - w
        rate = 1.0
        while rate > 1e-3 and loss(w + rate * step) >= now:
            rate /= 2
        if rate <= 1e-3:
            break
        w = w + rate * step
        now = loss(w)
    return w[:-1], float(w[-1])


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve through labels (0, 1), both classes of equal weight and none certain."""
    target = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    x = np.stack((margin, np.ones(len(margin))), axis=1)
    v = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        slope = x.T @ (weight * (p - target)) + 1e-4 * v
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        v -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return (float(v[0]), float(-v[1] / v[0])) if v[0] > 1e-6 else (1.0, float(np.median(margin)))


def train_machine(words: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> Machine:
    """words with labels 1 and -1, the most telling first. Half the landmarks are of each class."""
    rng = np.random.default_rng(seed)
    alphabet = "".join(sorted(set("".join(w for w, s in zip(words, y) if s > 0) + "".join(words[:2000]))))[:180]
    half = LANDMARKS // 2
    landmarks = [words[i] for s in (1, -1) for i in np.flatnonzero(y == s)[:half].tolist()]
    insert = [c for c in alphabet if c.isalpha()] or ["x"]
    spoiled = [w[: (k := int(rng.integers(1, max(2, len(w))))) ] + insert[int(rng.integers(len(insert)))] + w[k:] for w, s in zip(words, y) if s > 0]
    words = [*words, *spoiled]
    weight = np.concatenate((weight, 0.5 * weight[y > 0]))
    y = np.concatenate((y, np.ones(len(spoiled))))
    weight = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum())
    parts = Subsequences(alphabet)
    codes = np.unique(np.concatenate([code for _, code, _ in parts.parts(landmarks)]))
    own = parts.dense(landmarks, codes)
    value, vector = np.linalg.eigh(own.astype(np.float64) @ own.T)
    sound = value > 1e-6 * value.max()
    root = (vector[:, sound] / np.sqrt(value[sound])).astype(np.float32)  # kernel with the landmarks times this: Nyström features
    x = np.concatenate([parts.dense(words[i : i + 256], codes) @ own.T @ root for i in range(0, len(words), 256)])
    w, shift = fit_margin(x, y, weight)
    return Machine(alphabet, codes, own.T.astype(np.float64) @ (root @ w), shift)


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text of a bounded sample of the labelled documents that aren't held out."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    there = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for toxic, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        share = F.when(F.col("toxic") == toxic, F.lit(min(1.0, most / max(1, there.get(toxic, 0))))).otherwise(share)
    chosen = marked.where(F.pmod(F.xxhash64("of", F.lit(23)), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * (MOST_TOXIC + MOST_CLEAN))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["of"]).select("toxic", "text").distinct()


def word_evidence(sample: DataFrame) -> DataFrame:
    """word, pos, neg: the distinct toxic and clean sentences that have it, more than two letters long."""
    said = sample.select("toxic", F.explode(F.split(F.lower("text"), SENTENCE)).alias("sentence")).select("toxic", F.trim("sentence").alias("sentence")).distinct()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            toxic, found = [], []
            for y, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = {w for w in LETTERS.findall(s) if 2 < len(w) <= 40}
                toxic += [y] * len(here)
                found += here
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(found, pa.string())], names=["toxic", "word"])

    return said.mapInArrow(run, "toxic int, word string").groupBy("word").agg(F.sum("toxic").cast("double").alias("pos"), F.sum(1 - F.col("toxic")).cast("double").alias("neg"))


def trained(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine from a sample of labelled documents, or None if it has not both classes and a positive word."""
    spark = docs.sparkSession
    sample = materialize(sampled(docs, labels), "labelled").repartition(max(1, spark.sparkContext.defaultParallelism))
    evidence = materialize(word_evidence(sample), "evidence")
    pos, neg, many = evidence.agg(F.sum("pos"), F.sum("neg"), F.count(F.lit(1))).first()
    if not pos or not neg:
        return None
    base, n = pos / (pos + neg), F.col("pos") + F.col("neg")
    rate = F.col("pos") / n
    log = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))
    tail = n * (log(rate, F.lit(base)) + log(1 - rate, F.lit(1 - base)))  # of the binomial distribution: exp(-tail) bounds its chance
    judged = evidence.withColumn("tail", F.when(rate > base, tail).otherwise(F.lit(0.0)))
    telling = (F.col("tail") > float(np.log(many / 0.1))) & (rate > 0.5)
    positive = judged.where(telling).orderBy(F.desc("tail"), "word").limit(POSITIVE).collect()
    if not positive:
        return None
    others = judged.where((F.col("neg") > 0) & ~telling)
    chosen = others.orderBy(F.xxhash64("word", F.lit(5))).limit(NEGATIVE // 2).collect() + others.orderBy(F.desc("neg"), "word").limit(NEGATIVE // 2).collect()
    negative = {r["word"]: 1.0 + np.log1p(r["neg"]) for r in chosen}
    heavy: dict[str, float] = {}
    machine = None
    for again in range(ROUNDS + 1):
        first = list(heavy)[: LANDMARKS // 4]  # half of the negative landmarks are hard ones
        rest = [w for w in negative if w not in first]
        words = [r["word"] for r in positive] + first + rest
        weight = np.array([np.sqrt(r["pos"]) for r in positive] + [negative[w] for w in (*first, *rest)])
        machine = train_machine(words, np.array([1.0] * len(positive) + [-1.0] * (len(first) + len(rest))), weight)
        if again < ROUNDS:
            hard = with_margin(others.select("word", "neg"), machine, "word").orderBy(F.desc("margin"), "word").limit(HARD).collect()
            heavy = {r["word"]: 1.0 + np.log1p(r["neg"]) for r in hard}
            negative |= heavy
    got = with_margin(sample.select("text", "toxic"), machine, "text").select("margin", "toxic").where("margin > double('-inf')").collect()
    if got:
        machine.slope, machine.middle = fit_curve(np.array([r["margin"] for r in got]), np.array([float(r["toxic"]) for r in got]))
    return machine


def with_margin(rows: DataFrame, machine: Machine, text: str) -> DataFrame:
    """rows with the margin of their text's worst word."""
    known = rows.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([*rows.schema.fields, T.StructField("margin", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for group in grouped((t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()), lambda t: len(t) + 1, 1 << 21):
                here = batch.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([*here.columns, pa.array(known.value.text_margins(group), pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold)."""
    machine = trained(docs, labels)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    if machine is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    margin = F.greatest("margin", F.lit(machine.shift - 10))
    score = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(machine.slope) * (margin - F.lit(machine.middle)), F.lit(-40.0)), F.lit(40.0))))
    scored = with_margin(rows, machine, "text").select("doc_id", "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
