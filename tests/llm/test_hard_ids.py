"""Null, repeated and very large ids, and operators against independent brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from campaignry.llm import chat, common, fingerprints, language_id, mixing, simhash_dedup, token_counts, token_io, topk
from campaignry.llm.registry import vocabulary

BIG = 2**53 + 1
IDS = [None, None, BIG, BIG + 2, 2**63 - 1, -(2**63), 7, 7, 0]
TEXTS = ["one lonely text of a null id", "another text of a null id, unlike it", "a b c", None, "", "Some Words in a row, some words in a ROW", "x" * 300, "seven again, with more words", "ünïcode wörds ②"]
ROWS = [(i, t, "s", 1) for i, t in zip(IDS, TEXTS)]
SCHEMA = "doc_id long, text string, source string, id long"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2)


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_token_counts_keep_ids(hard):
    got = as_rows(token_counts.count_tokens(hard, vocabulary("byte_bpe_50k.json")), "doc_id", "n_bytes")
    assert got == sorted(((i, len((t or "").encode())) for i, t in zip(IDS, TEXTS)), key=str)


def test_token_files_keep_ids(spark, hard, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    token_io.write_tokens(hard, vocabulary("word_bpe_49k.json"), str(tmp_path / "t"))
    got = [tuple(r) for r in token_io.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted(IDS, key=lambda i: (i is not None, i or 0))
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in zip(IDS, TEXTS)}
    assert sorted((i, n, c) for i, _, n, c in got if i is not None) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in ids.items() if i is not None)
    assert [s for _, s, _, _ in got] == np.cumsum([0, *[n for _, _, n, _ in got[:-1]]]).tolist()


def plain_simhash(text, words=3):
    """An independent fingerprint: strings, per-bit counters."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    out = 0
    for bit in range(64):
        if sum(xxhash.xxh64(s.encode(), seed=42).intdigest() >> bit & 1 for s in shingles) * 2 > len(shingles):
            out |= 1 << bit
    return out


def groups_of(fps):
    """A root for each distinct fingerprint, over links of 2 bits or fewer."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}


def test_near_duplicates_against_an_independent_fingerprint(spark, hard):
    rows = [(i, t) for i, t in zip(IDS, TEXTS)]
    fps = [plain_simhash(t) for _, t in rows]
    group = groups_of(fps)
    least = {g: min((i for (i, _), f in zip(rows, fps) if group[f] == g and i is not None), default=None) for g in group.values()}
    want = sorted(((i, f"{f:016x}", least[group[f]]) for (i, _), f in zip(rows, fps)), key=str)
    assert as_rows(simhash_dedup.near_duplicates(hard), "doc_id", "fingerprint", "component_id") == want
    kept = simhash_dedup.one_of_each(hard)
    assert kept.count() == len(set(group.values())) and kept.columns == hard.columns
    one = {"one lonely text of a null id", "another text of a null id, unlike it"}
    assert one <= {r["text"] for r in kept.collect()}  # unlike texts of null ids stay


def test_one_of_each_collapses_identical_rows(spark):
    rows = [(None, "the same text in every row", "s", k) for k in range(20)] + [(3, "quite another text than that", "s", 1)] * 5
    kept = simhash_dedup.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "the same text in every row"), (3, "quite another text than that")]


def plain_votes(text):
    """A text's terms; one that begins or ends with white space has an empty term there."""
    return Counter(re.split(r"[\x20\t-\r]+", text.lower()))


def test_fingerprints_against_brute_force(spark):
    rows = [(5, "alpha beta gamma delta epsilon zeta eta theta"), (5, "alpha beta"), (None, "alpha beta gamma delta epsilon zeta eta iota"), (9, None), (BIG, "Kappa  lambda\nmu"), (None, "lonely"), (12, "alpha beta gamma delta epsilon zeta eta theta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [(i, t or "") for i, t in rows]
    order = [None, 5, 9, 12, BIG]
    after = dict(zip(order, order[1:] + order[:1]))
    first = {i: min((t for j, t in plain if j == i), key=lambda t: hashlib.sha256(t.encode()).digest()) for i in order}
    edited = {(i, t): t[: len(t) - len(t) // 4] + first[after[i]][: len(t) // 4] for i, t in plain}
    words = sorted({w for t in [*edited.values(), *(t for _, t in plain)] for w in plain_votes(t)})
    hashes = {r["w"]: r["h"] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def fp(text):
        terms = plain_votes(text)
        total = sum(n * min(len(w), 16) for w, n in terms.items())
        return sum(1 << b for b in range(64) if 2 * sum(n * min(len(w), 16) for w, n in terms.items() if hashes[w] >> b & 1) > total)

    def near(a, b):
        return 1 - (a ^ b).bit_count() / 64

    group = groups_of([fp(t) for _, t in plain])
    least = {g: min((i for i, t in plain if group[fp(t)] == g and i is not None), default=None) for g in group.values()}
    want = [(i, len(t), hashlib.sha256(edited[i, t].encode()).hexdigest(), f"{fp(t):016x}", f"{fp(edited[i, t]):016x}", near(fp(t), fp(edited[i, t])), near(fp(t), fp(first[after[i]])), least[group[fp(t)]]) for i, t in plain]
    got = as_rows(fingerprints.fingerprint_documents(df), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_group")
    assert got == sorted(want, key=str)


def test_mixing_equals_plain_poisson(spark):
    rows = [(i % 40 or None, f"text {i}", "ab"[i % 3 == 0]) for i in range(300)]
    got = Counter((r["doc_id"], r["text"]) for r in mixing.poisson_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 1.0, "b": 1.0}, total_rows=900).collect())
    sizes = Counter(s for *_, s in rows)
    want = Counter()
    for i, t, s in rows:
        mean = 450 / sizes[s]
        key = "|".join([*([str(i)] if i is not None else []), hashlib.md5(t.encode()).hexdigest()])
        u = int(hashlib.md5(f"42|{key}|1".encode()).hexdigest()[:13], 16) / 2**52
        n, p, c = 0, np.exp(-mean), np.exp(-mean)
        while c <= u:
            n += 1
            p *= mean / n
            c += p
        if n:
            want[i, t] = n
    assert got == want


def test_identical_query_ids_take_the_least_vector(spark):
    rows = [(50, [2.0, 1.0]), (50, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])] + [(3, [0.5, 0.5])] * 3
    got = sorted(map(tuple, topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50, 2).collect()))
    assert got == [(50, 1, 2, 256 * 256 * 5), (50, 2, 3, 256 * 128 + 256 * 5 * 128)]


def test_a_null_conversation_of_null_turns_is_numbered(spark):
    rows = [(None, None, "user", f"t{i:03}") for i in range(700)] + [(1, 2, "user", "b"), (1, None, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted(tuple(r) for r in chat.hashed_turns(df).where("conv_id IS NULL").select("at", "text").collect())
    assert got == [(i, f"t{i:03}") for i in range(700)]
    assert [r["text"] for r in chat.hashed_turns(df).where("conv_id = 1").orderBy("at").collect()] == ["a", "b"]


def test_join_by_key_with_and_without_hot_keys(spark):
    rows = spark.range(30000).select((F.when(F.col("id") < 9000, -1).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    of = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.join_by_key(rows, of, "k", "n")
    assert got.count() == 30000 and got.where("k = -1 AND n = 9000").count() == 9000 and got.where("k > -1 AND n = 1").count() == 21000


def test_an_unshared_folder_is_refused(spark):
    class Conf:
        get = staticmethod(lambda k: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def naive_probabilities(network, window):
    """Convolution by loops over places and filters."""
    t = network.table
    pooled = []
    for w in language_id.WIDTHS:
        for f in range(language_id.FILTERS):
            pooled.append(max(sum(float(t[f"t{w}{k}"][window[p + k], f]) for k in range(w)) for p in range(len(window) - w + 1)))
    hidden = np.maximum(np.array(pooled) + t["bias"], 0)
    z = hidden @ t["out"] + t["shift"]
    e = np.exp(z - z.max())
    return e / e.sum()


def test_network_equals_naive_convolution():
    network = language_id.ByteNetwork(["a", "b", "c"])
    x = np.random.default_rng(1).integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    assert np.allclose(network.probabilities(x), [naive_probabilities(network, r) for r in x], atol=1e-5)


def test_gradients_equal_differences():
    network = language_id.ByteNetwork(["a", "b"], seed=3)
    network.table = {k: v.astype(np.float64) for k, v in network.table.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 110, (6, 40)).astype(np.uint8), rng.integers(0, 2, 6)
    grad = network.gradients(x, y)

    def loss():
        return -np.log(network.probabilities(x)[np.arange(6), y]).mean()

    for name, g in grad.items():
        flat = network.table[name].reshape(-1)
        for at in np.argsort(-np.abs(np.asarray(g).reshape(-1)))[:3]:
            keep, step = flat[at], 1e-6
            flat[at] = keep + step
            up = loss()
            flat[at] = keep - step
            down = loss()
            flat[at] = keep
            assert abs((up - down) / (2 * step) - np.asarray(g).reshape(-1)[at]) < 1e-5, name


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 511, 2000):
        text = bytes(1 + i % 250 for i in range(n))
        x, owner, size = language_id.windows([text, b"z"])
        step = language_id.WINDOW - max(language_id.WIDTHS) + 1
        mine = x[owner == 0]
        assert (mine == [np.frombuffer(text[i * step : i * step + language_id.WINDOW].ljust(language_id.WINDOW, b"\0"), np.uint8) for i in range(len(mine))]).all()
        assert (len(mine) - 1) * step + language_id.WINDOW >= n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pred = language_id.predict_languages(docs, language_id.train_network(docs)).where("held_out").join(docs.select("doc_id", "lang").where("lang IS NOT NULL"), "doc_id")
    right, n = pred.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right / n >= 0.9
