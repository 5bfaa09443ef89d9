"""The toxicity machine: its kernel against the plain definition, gapped insults, held-out accuracy, edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest

from campaignry.llm import toxicity

WORDS = "house river window quiet morning letter garden stone bridge market evening winter summer paper music travel simple".split()
BAD = ["idiot", "moron", "stupid"]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(700):
        words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) for _ in range(rng.randrange(20, 60))]
        bad = i % 5 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words) + ".", "en", "s", 0.5, 7))
        if i % 3:
            labels.append((i, 1, int(bad)))
    docs += [(5000, None, "en", "s", 0.5, 7), (5001, "", None, None, 0.5, 7), (5002, "12 !", "en", "s", 0.5, 7), (5003, "you i d i o t", "en", "s", 0.5, 7), (5004, "an i.d.i.o.t of winter", "en", "s", 0.5, 7), (5005, "an idxiot, sure", "en", "s", 0.5, 7), (None, "the stupid garden", "en", "s", 0.5, 7), (5006, "IDIOT " + "river " * 3000, "en", "s", 0.5, 7)]
    docs += [docs[0]] * 3
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double, toxic int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def scored(tables):
    return [tuple(r) for r in toxicity.score_documents(*tables).collect()]


def test_scores(tables, scored):
    truth = {i: int(i % 5 == 0) for i in range(700)}
    assert len(scored) == tables[0].count() and all(0 <= s <= 1 and p == int(s >= 0.7) for _, _, s, p in scored)
    assert all(h == (i is not None and held(i)) for i, h, *_ in scored)
    mine = [(truth[i], p) for i, h, _, p in scored if i in truth and h]
    assert len(mine) > 150 and sum(t == p for t, p in mine) / len(mine) > 0.97
    by = {i: p for i, _, _, p in scored}
    assert by[5000] == by[5001] == by[5002] == 0
    assert by[5003] == by[5004] == by[5005] == by[5006] == by[None] == 1


def test_without_labels_all_score_zero(spark, tables):
    docs, labels = tables
    assert {r["score"] for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score_documents(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_margins_are_the_kernel_expansion():
    """The folded weights give the sum over landmarks of weight times kernel, with the kernel by its definition."""

    def kernel(a, b):
        def features(w):
            w, out = f"^{w}$", {}
            for p in toxicity.PATTERNS:
                for i in range(len(w) - p[-1]):
                    u = tuple(w[i + k] for k in p)
                    out[u] = out.get(u, 0) + toxicity.DECAY ** (p[-1] + 1)
            return out

        fa, fb = features(a), features(b)
        return sum(v * fb.get(u, 0) for u, v in fa.items()) / toxicity.Subsequences.scale([a])[0] / toxicity.Subsequences.scale([b])[0]

    words = ["idiot", "idioten", "moron", "garden", "gardens", "aaaa", "x"]
    parts = toxicity.Subsequences("".join(words))
    codes = np.unique(np.concatenate([c for _, c, _ in parts.parts(words)]))
    dense = parts.dense(words, codes)
    got = dense @ dense.T
    want = np.array([[kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-5)
    machine = toxicity.Machine("".join(words), codes, dense[0].astype(float), 0.25)
    assert np.allclose(machine.margins(words), want[:, 0] + 0.25, atol=1e-5)
    assert kernel("idiot", "idxiot") > 2 * max(kernel("idiot", w) for w in ("garden", "moron", "river"))


def test_words_of_tokens():
    assert toxicity.words_of("i.d.i.o.t!") == ["i", "d", "i", "o", "t", "idiot"]
    assert toxicity.words_of("(house),") == ["house"] and toxicity.words_of("12!") == []
    assert toxicity.spaced("you i d i o t".split()) == ["idiot"]
    assert len(set(toxicity.PATTERNS)) == len(toxicity.PATTERNS) == len(list(itertools.combinations(range(5), 2))) + len(list(itertools.combinations(range(5), 3)))
