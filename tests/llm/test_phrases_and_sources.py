"""Phrase collocations and source divergence against brute force; the counters and the perfect hash that they rest on."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from campaignry.llm import divergence, perfect_hash, phrases, sketch

SCHEMA = "doc_id long, text string, lang string, source string, a long, score long, n long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_collocations(rows, least=30, most=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    out = {}
    for (lang, w), a in cands.items():
        if 100 * longer[lang, w] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:most]))


def plain_divergence(rows, least=3):
    docs = [(lang or "", source or "", [lower(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    df, counts, groups = Counter(), {}, sorted({(g, s) for g, s, _ in docs})
    for g, s, terms in docs:
        df.update((g, t) for t in set(terms))
        counts.setdefault((g, s), Counter()).update(terms)
    out = []
    for g, s in groups:
        kept = sorted(t for (h, t), n in df.items() if h == g and n >= least)
        v = len(kept)
        total = {h: sum(counts[h][t] for t in kept) for h in groups if h[0] == g}
        whole = Counter()
        for h in total:
            whole.update({t: counts[h][t] for t in kept})
        p = lambda h, t: 1 + 10**9 * (counts[h][t] + 1) // (total[h] + v)
        value = lambda x, y: (x - y) ** 2 // y
        pair = [(-sum(value(p((g, s), t), p(h, t)) for t in kept), h[1].encode()) for h in total if h != (g, s)]
        n = sum(whole.values())
        terms = [(-value(x, q), t.encode()) for t in kept if counts[g, s][t] for x, q in [(p((g, s), t), 1 + 10**9 * (whole[t] + 1) // (n + v))] if x > q]
        for part, found, most in (("pair", pair, None), ("term", terms, 200)):
            out += [(g, s, part, i.decode(), -x, k + 1) for k, (x, i) in enumerate(sorted(found)[:most])]
    return sorted(out)


def made(seed=3, n=260):
    rng = random.Random(seed)
    words = "the The cat sat on mat Ünï日本 don't x1 a b c new york city hall über ÄB".split()
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x1c", "-"]) for _ in range(rng.randrange(60)))
        text += rng.choice(["", "new york city hall", " New York City hall. san francisco bay"])
        rows.append((i % 200 if i % 7 else None, rng.choice([text, text, text, None, ""]) if i % 9 == 0 else text, rng.choice(["en", "en", "de", None, "", "und"]), f"s{rng.randrange(4)}" if rng.random() < 0.9 else None, 1, 2, 3))
    return rows + rows[:20]


@pytest.fixture(scope="module")
def rows():
    return made()


def test_collocations_equal_brute_force(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == plain_collocations(rows)
    want = plain_collocations(rows, 5)
    assert len(want) > 50
    assert sorted(map(tuple, phrases.collocations(df, 5).collect())) == want


def test_collocations_in_small_blocks_and_groups(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "KEYS", 64)
    monkeypatch.setattr(phrases, "GROUP_BYTES", 4000)
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, SCHEMA), 5, 7).collect())) == plain_collocations(rows, 5, 7)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, 1, 1, 1), (2, "a b", "en", "s", 1, 1, 1)], SCHEMA)).count() == 0
    assert divergence.source_divergence(df).count() == 0


def test_long_texts_lose_no_phrase_between_chunks(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 7)
    monkeypatch.setattr(phrases, "PART", 10)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "cc", "d."]) for _ in range(rng.randrange(50))) for _ in range(30)]
    got, n = Counter(), 0
    for words, again in phrases.chunks(texts):
        found = phrases.Phrases(words, again, "en")
        n += found.n_words
        for i in range(4):
            for k, key in zip(found.alive[i].tolist(), found.keys(i, found.alive[i]).to_pylist()):
                got[key.partition(b"\t")[2].decode()] += int(found.count[i][k])
    want = Counter()
    for t in texts:
        for piece in t.split("."):
            w = piece.split()
            want.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == want and n == sum(len(t.replace(".", " ").split()) for t in texts)


def test_divergence_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain_divergence(rows)
    assert {w[2] for w in want} == {"pair", "term"}
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == want


def test_sources_without_terms(spark):
    rows = [(1, None, "en", "a"), (2, "12 !", "en", "b"), (3, "x", None, None), (4, "x", None, None), (5, "x y", "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == plain_divergence(rows)


def test_division_of_great_numbers(spark):
    cases = [(1, 1), (3, 7), (9 * 10**15, 9 * 10**15), (123456789012345, 8999999999999999), (1, 9 * 10**15)]
    df = spark.createDataFrame(cases, "a long, b long")
    assert [r[0] for r in df.select(divergence.share("a", "b")).collect()] == [1 + 10**9 * a // b for a, b in cases]


def test_counters_never_underestimate(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 30000).astype(np.uint64)
    width = sketch.width_for(100)
    blocks, true = [], Counter()
    for part in np.array_split(rng.choice(keys, 90000), 3):
        c = sketch.Counters(1, width)
        c.add(0, (part & np.uint64(width - 1)).astype(np.int64), np.ones(len(part), np.int64))
        blocks += list(c.blocks())
        true.update(part.tolist())
    bits = sketch.summed_bits(spark.createDataFrame(blocks, sketch.SCHEMA), 1, width, 5)
    found = sketch.reaches(bits[0], (keys & np.uint64(width - 1)).astype(np.int64))
    assert all(f or true[int(k)] < 5 for k, f in zip(keys, found)) and 0 < found.sum() < len(keys)
    assert sketch.width_for(1e30) == sketch.MOST_WIDTH and sketch.width_for(0) == sketch.BLOCK


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5000):
        keys = np.array([b"k%d" % i for i in range(n)], object)
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        if n > 2:
            h[:3] = h[3]  # equal hashes of different keys
        sizes, bits, slot = perfect_hash.build(h)
        assert sorted(slot.tolist()) == list(range(n))
        stored = np.empty(n, object)
        stored[slot] = keys
        table = perfect_hash.Slots(sizes, bits, pa.array(stored.tolist(), pa.binary()))
        assert table.find(h, pa.array(keys.tolist(), pa.binary())).tolist() == slot.tolist()
        other = rng.integers(0, 2**63, 500).astype(np.uint64)
        assert (table.find(other, pa.array([b"x%d" % i for i in range(500)], pa.binary())) == -1).all()
