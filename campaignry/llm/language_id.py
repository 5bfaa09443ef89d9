"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each filter's greatest answer in a window goes
through a softmax layer. As the input is one byte of 256, a filter is a table of a weight for each byte and place. The
network is trained in numpy on windows of a bounded, hash-chosen sample of labelled documents, about PER_LANGUAGE of
each language (fewer where that would be more than MOST_DOCUMENTS in all), WINDOWS_A_DOCUMENT windows of each. Prediction covers every window of a text; a document's score is the
mean probability of its language over them, by their bytes.

Edge cases: a text that is null or has no letter is `und` with score 0; without any labelled document all are; a short
text is padded with zero bytes; a very long one is handled in groups of windows; repeated rows give a row each; an
empty table gives an empty result; other columns are ignored by predict_languages and kept by known_language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANGUAGE, WINDOWS_A_DOCUMENT, MOST_DOCUMENTS = 300, 4, 60_000
#: The table of languages is broadcast only up to so many.
BROADCAST_LANGUAGES = 10_000
EPOCHS, BATCH, RATE = 5, 64, 0.01
#: Windows that go through the network at once.
AT_ONCE = 128
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: known_language drops documents below this score. With two languages even a coin has a half; sound text comes near 1.
LEAST_SCORE = 0.4


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (with zeros after a text's end), the text of each and its bytes."""
    step = WINDOW - max(WIDTHS) + 1
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t + bytes(WINDOW) for t in texts), np.uint8)
    many = np.maximum(1, -(-(size - WINDOW) // step) + 1)
    owner = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(np.cumsum(size + WINDOW) - size - WINDOW, many) + nth * step
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[begin], owner, np.minimum(size[owner] - nth * step, WINDOW)


class ByteNetwork:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.table = {f"t{w}{k}": rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for w in WIDTHS for k in range(w)}
        self.table |= {"bias": np.zeros(len(WIDTHS) * FILTERS, np.float32), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), "shift": np.zeros(len(languages), np.float32)}

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's greatest answer in each window, and where it was."""
        best, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            answer = self.table[f"t{w}0"][x[:, :n]]
            for k in range(1, w):
                answer += self.table[f"t{w}{k}"][x[:, k : n + k]]
            best.append(answer.max(axis=1))
            where.append(answer.argmax(axis=1) if places else None)
        return np.concatenate(best, axis=1) + self.table["bias"], where

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = [self.softmax(np.maximum(self.pooled(x[i : i + AT_ONCE])[0], 0) @ self.table["out"] + self.table["shift"]) for i in range(0, len(x), AT_ONCE)]
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        raw, where = self.pooled(x, True)
        hidden = np.maximum(raw, 0)
        wrong = self.softmax(hidden @ self.table["out"] + self.table["shift"])
        wrong[np.arange(len(y)), y] -= 1
        wrong /= len(y)
        back = (wrong @ self.table["out"].T) * (raw > 0)
        grad = {"out": hidden.T @ wrong, "shift": wrong.sum(axis=0), "bias": back.sum(axis=0)}
        row = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(w):
                cell = x[row, where[i] + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
                grad[f"t{w}{k}"] = np.bincount(cell.ravel(), part.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> ByteNetwork:
        """Adam over shuffled batches."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({n: np.zeros_like(t) for n, t in self.table.items()} for _ in range(2))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(order), BATCH):
                step += 1
                for n, g in self.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.999 * v[n] + 0.001 * g * g
                    self.table[n] -= (RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text, over all its windows."""
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        language, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            x, owner, size = windows([texts[i].encode("utf-8", "surrogatepass") for i in known])
            total = np.zeros((len(known), len(self.languages)))
            for i in range(0, len(x), AT_ONCE):
                np.add.at(total, owner[i : i + AT_ONCE], self.probabilities(x[i : i + AT_ONCE]) * size[i : i + AT_ONCE, None])
            total /= total.sum(axis=1, keepdims=True)
            for i, p in zip(known, total):
                language[i], score[i] = self.languages[int(p.argmax())], float(p.max())
        return language, score


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_network(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNetwork:
    """A network from labelled documents that aren't held out; the sample is about per_language documents of each language, MOST_DOCUMENTS in all."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out()).withColumn("_of", F.col("lang"))
    counts = {r[0]: r[1] for r in labelled.groupBy("_of").count().collect()}
    languages = sorted(counts)
    if not languages:
        return ByteNetwork([])
    per_language = max(1, min(per_language, MOST_DOCUMENTS // len(languages)))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in counts.items()], "_of string, _share double")
    known = labelled.select("doc_id", "text", "lang", "_of").join(F.broadcast(shares) if len(languages) <= BROADCAST_LANGUAGES else shares, "_of")
    chosen = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)).where(F.col("text").isNotNull())
    last = F.greatest(F.length("text") - WINDOW, F.lit(0))
    spots = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_A_DOCUMENT - 1)), lambda i: F.substr("text", (F.lit(1) + last * i / max(1, WINDOWS_A_DOCUMENT - 1)).cast("int"), F.lit(WINDOW)))
    rows = chosen.select("lang", F.array_distinct(spots).alias("spots")).limit(4 * max(per_language * len(languages), MOST_DOCUMENTS // 4)).collect()
    texts = sorted((r["lang"], t) for r in rows for t in r["spots"] if LETTER.search(t))
    if not texts:
        return ByteNetwork([])
    x = np.stack([np.frombuffer(t.encode("utf-8", "surrogatepass")[:WINDOW].ljust(WINDOW, b"\0"), np.uint8) for _, t in texts])
    place = {g: i for i, g in enumerate(languages)}
    return ByteNetwork(languages).train(x, np.array([place[g] for g, _ in texts]))


def predict_languages(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    from .ragged import grouped

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for group in grouped(batch["text"].tolist(), lambda t: len(t or "") + 1):
                language, score = network.predict(group)
                yield batch.iloc[at : at + len(group)][["doc_id", "held_out"]].assign(lang_pred=language, score=score)
                at += len(group)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def known_language(docs: DataFrame, network: ByteNetwork, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language the network knows: not `und`, and a score of least or more."""
    from .ragged import grouped

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, texts = 0, batch.column(batch.schema.get_field_index("text")).to_pylist()
            for group in grouped(texts, lambda t: len(t or "") + 1):
                language, score = network.predict(group)
                keep = [g != UNKNOWN and s >= least for g, s in zip(language, score)]
                yield batch.slice(at, len(group)).filter(pa.array(keep, pa.bool_()))
                at += len(group)

    return docs.mapInArrow(run, docs.schema)
