"""Texts longer than a piece, very many languages, and one id or vector on a third of all rows."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignry.llm import fingerprints, language_id, ragged, sentencepiece_sa, token_counts, token_io, topk
from campaignry.llm.registry import vocabulary


def hostile(n, seed=5):
    rng = random.Random(seed)
    bits = ["▁", " ", "  ", "a", "word", "\n", "é", "日本", "'s", " 12", "!", "▁ ▁", "x y z", "<|endoftext|>", "\t", "👍"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("size", [8, 30])
def test_cut_texts_equal_the_libraries(monkeypatch, size):
    import sentencepiece
    from tokenizers import Tokenizer

    for module in (sentencepiece_sa, token_counts, token_io):
        if hasattr(module, "pieces"):
            monkeypatch.setattr(module, "pieces", functools.partial(ragged.pieces, size=size))
    texts = hostile(1500)
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = sentencepiece_sa.PieceModel(vocabulary("piece_bpe_32k.model")).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [library.encode(t) for t in texts]
    counts = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert token_counts.ByteBPE(vocabulary("byte_bpe_50k.json")).count(texts) == [len(counts.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_text_beyond_a_piece_with_torn_spaces():
    import sentencepiece

    text = "word " * 209715 + "x▁ ▁y z" + " end of text" * 3
    assert len(text) > ragged.PIECE
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = sentencepiece_sa.PieceModel(vocabulary("piece_bpe_32k.model")).encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == library.encode(text)


def test_more_than_500_languages(spark):
    rows = [(2000 * k + i, f"lang{k:03} " * 10, f"g{k:03}", "s") for k in range(501) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    network = language_id.train_network(df, per_language=1)
    assert 350 < len(network.languages) <= 501
    assert language_id.predict_languages(df, network).where("lang_pred = 'und'").count() == 0


def test_one_id_on_a_third_of_all_rows(spark):
    rows = [(7, f"hot text {i} " + "tail " * (i % 9), "s") for i in range(400)] + [(1000 + i, f"other text {i} end", "s") for i in range(800)]
    rows += [rows[0]] * 3
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    of = {}
    for i, t, _ in rows:
        of.setdefault(i, []).append(t)
    least = {i: min(ts, key=lambda t: hashlib.sha256(t.encode()).digest()) for i, ts in of.items()}
    order = sorted(of)
    following = dict(zip(order, [*order[1:], order[0]]))
    want = sorted((i, digest(t[: len(t) - len(t) // 4] + least[following[i]][: len(t) // 4])) for i, t, _ in rows)
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in got) == want
    hot = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    parts = fingerprints.with_edited(hot)[0].where("id = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts > 20


def test_one_vector_on_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (400, 3)).round(1)
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(399, [float(x) for x in v[399]])] * 200
    got = sorted(map(tuple, topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()))
    e = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(int)
    ids, want = np.array([r[0] for r in rows]), []
    for q in range(0, 400, 50):
        s = e @ e[q]
        want += [(q, k + 1, int(ids[i]), int(s[i])) for k, i in enumerate([i for i in np.lexsort((ids, -s)).tolist() if ids[i] != q][:5])]
    assert got == sorted(want)
