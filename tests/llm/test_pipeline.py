"""corpus_pipeline.run against a plain version of its four stages."""

import hashlib
from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline
from campaignry.llm import language_id, mixing
from campaignry.llm.registry import vocabulary

from test_hard_ids import groups_of, naive_probabilities, plain_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _copy long"
WORDS = {"en": "the and with of house river stone bright morning never", "de": "der und mit von haus straße fluß stein hell morgen"}


def fixture():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(90):
        g = ("en", "de")[i % 2]
        rows.append((i if i % 9 else None, " ".join(rng.choice(WORDS[g].split(), int(rng.integers(20, 60)))), g if i % 5 else None, "big" if i % 3 else None))
    rows += [(200 + k, rows[4][1], "en", "big") for k in range(6)]  # exact copies
    rows += [(4, rows[7][1] + " und mehr davon hier", "de", "other"), (None, rows[8][1], "en", "big"), rows[10], rows[10]]
    rows += [(300, None, "en", "big"), (301, "", "de", "other"), (302, "12345 !!!", None, "other")]
    return [(*r, len(r[1] or ""), 1) for r in rows]


def plain_language(rows, network):
    kept = []
    for r in rows:
        text = r[1]
        if not text or not language_id.LETTER.search(text):
            continue
        x, _, size = language_id.windows([text.encode()])
        total = sum(naive_probabilities(network, w) * n for w, n in zip(x, size))
        if (total / total.sum()).max() >= language_id.LEAST_SCORE:
            kept.append(r)
    return kept


def plain_dedup(rows):
    fps = [plain_simhash(r[1]) for r in rows]
    group = groups_of(fps)
    best = {}
    for r, f in zip(rows, fps):
        key = (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
        if group[f] not in best or key < best[group[f]][0]:
            best[group[f]] = (key, r)
    return [r for _, r in best.values()]


def plain_mix(rows):
    sizes = Counter(r[3] for r in rows)
    weights = {s: n**0.5 for s, n in sizes.items()}
    out = []
    for r in rows:
        mean = weights[r[3]] / sum(weights.values()) * len(rows) / sizes[r[3]]
        assert mean <= mixing.PART_MEAN
        key = "|".join([*([str(r[0])] if r[0] is not None else []), hashlib.md5((r[1] or "").encode()).hexdigest()])
        u = int(hashlib.md5(f"42|{key}|1".encode()).hexdigest()[:13], 16) / 2**52
        n, p, c = 0, np.exp(-mean), np.exp(-mean)
        while c <= u:
            n += 1
            p *= mean / n
            c += p
        out += [r] * n
    return out


def test_run_equals_the_plain_stages(spark, tmp_path):
    docs = spark.createDataFrame(fixture(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    network = language_id.train_network(docs)
    known = plain_language(rows, network)
    assert len(known) == len(rows) - 3
    one = plain_dedup(known)
    assert len(one) < len(known) - 6
    mixed = plain_mix(one)
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = Counter((*r, tuple(library.encode(r[1])), library.decode(library.encode(r[1]))) for r in mixed)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((*tuple(r)[:6], tuple(r["piece_ids"]), r["decoded"]) for r in got) == want
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "mixing sources", "SentencePiece"]
    for name in list(stages)[:3]:
        assert stages[name](spark, docs, str(tmp_path)).columns == docs.columns


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
