"""The corpus operators against libraries and brute force: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignry.llm import chat, fingerprints, language_id, mixing, sentencepiece_sa, sharding, simhash_dedup, token_counts, token_io, topk
from campaignry.llm.registry import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, `bin` long"
TEXTS = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "It's a test, it's a TEST <|endoftext|> x.", "en", "a"), (4, "the cat sat on the mat " * 40, "en", "b"),
    (5, "the cat sat on the mat " * 40, "en", "b"), (6, "the cat sat on the mat " * 39 + "the dog", "en", None), (7, "日本語 é ②　x\x1cy 👍", "fr", "c"),
    (8, "word" * 5000 + " " + "a b " * 3000, "fr", "a"), (8, "word" * 5000 + " " + "a b " * 3000, "fr", "a"), (None, "no id", "en", "a"), (10, "  two  spaces\n\n", "fr", "c"), (11, "12345 !!!", "fr", "c"),
]
QUERIES = {
    "token_counts": lambda d: token_counts.count_tokens(d, vocabulary("byte_bpe_50k.json")), "near_duplicates": simhash_dedup.near_duplicates, "one_of_each": simhash_dedup.one_of_each, "fingerprints": fingerprints.fingerprint_documents,
    "sentencepiece": lambda d: sentencepiece_sa.encode_documents(d, vocabulary("piece_bpe_32k.model")), "sharding": sharding.shard_documents, "mixing": mixing.poisson_mix,
    "language": lambda d: language_id.predict_languages(d, language_id.train_network(d)), "known_language": lambda d: language_id.known_language(d, language_id.train_network(d)),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 5) for r in TEXTS], SCHEMA)


def by_id(df, *columns):
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table(spark, name):
    assert QUERIES[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in TEXTS), key=str)
    assert by_id(QUERIES["token_counts"](docs), "n_bytes", "n_tokens", "over_limit") == want


def test_near_duplicates_equal_brute_force(docs):
    fps = [(i, simhash_dedup.simhash(t)) for i, t, *_ in TEXTS]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((i for (i, _), h in zip(fps, group) if h == g and i is not None), default=None) for g in group}
    want = sorted(((i, f"{fp:016x}", least[g]) for (i, fp), g in zip(fps, group)), key=str)
    assert by_id(simhash_dedup.near_duplicates(docs), "fingerprint", "component_id") == want
    kept = [r["doc_id"] for r in simhash_dedup.one_of_each(docs).collect()]
    assert len(kept) == len(set(kept)) == len({c for _, _, c in want})


def test_links_of_very_many_close_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(0, 63, (60, 3))})
    rows = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    from campaignry.llm.hamming import components

    for tables in (simhash_dedup.pigeonring_tables(), fingerprints.block_tables()):
        assert {r["fp"]: r["component"] for r in components(rows, tables).collect()} == {fp: find(i) for i, fp in enumerate(fps)}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (120, 4)).round(1)
    v[40:90] = v[0]
    rows = [(i, [float(x) for x in v[i]], "x") for i in range(120)] + [(200, None, "x"), (250, [1.0, None, 2.0, 3.0], "x"), (300, [float("nan")] * 4, "x"), (350, [1.0], "x")]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 50 == 0)
    e = np.floor(256 * v.astype(np.float32).astype(np.float64)).astype(int)
    want = []
    for q in (0, 50, 100):
        s = e @ e[q]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate([i for i in np.lexsort((np.arange(120), -s)).tolist() if i != q][:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.exact_top_k(got.select(F.col("vec_id"), F.lit(None).cast("array<float>").alias("embedding")), F.lit(True)).count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    token_io.write_tokens(docs, vocabulary("word_bpe_49k.json"), str(tmp_path / "t"))
    at, want = 0, []
    for i, t, *_ in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert by_id(token_io.read_tokens(spark, str(tmp_path / "t")), "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    token_io.write_tokens(spark.createDataFrame([], SCHEMA), vocabulary("word_bpe_49k.json"), str(tmp_path / "e"))


def test_simple8b_values_of_all_widths():
    rng = np.random.default_rng(3)
    for n in (0, 1, 4096, 9001):
        ids = np.array([int(rng.integers(0, 2**63)) * 2 >> int(rng.integers(0, 64)) for _ in range(n)], np.uint64)
        data = token_io.encode_ids(ids)
        assert (token_io.decode_ids(data) == ids).all()
        if n:
            assert (token_io.decode_block(data, (n - 1) // token_io.BLOCK) == ids[(n - 1) // token_io.BLOCK * token_io.BLOCK :]).all()


def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, *_ in TEXTS), key=str)
    assert by_id(QUERIES["sentencepiece"](docs), "piece_ids", "decoded") == want


def test_edited_texts_and_fingerprints(docs):
    plain = {i: t or "" for i, t, *_ in TEXTS}
    order = [None, *sorted(i for i in plain if i is not None)]
    following = dict(zip(order, [*order[1:], order[0]]))
    for r in fingerprints.fingerprint_documents(docs).collect():
        t, n = plain[r["doc_id"]], plain[following[r["doc_id"]]]
        q = len(t) // 4
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1
        if r["doc_id"] in (4, 5):
            assert r["near_group"] == 4
    assert fingerprints.fingerprint_documents(docs).count() == len(TEXTS)


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) & (2**64 - 1)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(spark, docs):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *np.random.default_rng(4).integers(-(2**63), 2**63, 200).tolist()]
    rows = spark.createDataFrame([(k,) for k in keys], "key long")
    assert [r[0] for r in rows.select(sharding.jump_shard("key", 24)).collect()] == [jump(k, 24) for k in keys]
    got = sharding.shard_documents(docs, 3).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in got)
    assert all(r["size"] == len((dict((i, t) for i, t, *_ in TEXTS)[r["doc_id"]] or "").encode()) + 8 for r in got)


def test_mixing_reaches_the_targets(spark):
    rows = spark.createDataFrame([(i, "t", "big" if i % 3 else None, i) for i in range(6000)], "doc_id long, text string, source string, _copy long")
    got = {r["source"]: r["count"] for r in mixing.poisson_mix(rows, {"big": 3.0, "none": 1.0}).groupBy("source").count().collect()}
    assert set(got) == {"big"} and abs(got["big"] - 6000) < 400
    few = spark.createDataFrame([(1, "t", "a")], "doc_id long, text string, source string")
    assert abs(mixing.poisson_mix(few, total_rows=2000).count() - 2000) < 250


def test_language_network(spark):
    words = {"en": "the and with of house", "de": "der und mit von haus straße"}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words[g].split(), 30)), g, "s") for i in range(200) for g in (("en", "de")[i % 2],)]
    df = spark.createDataFrame([*rows, (900, None, "en", "s"), (901, "123 !", "de", "s")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language_id.predict_languages(df, language_id.train_network(df)).collect()}
    assert all(got[i]["lang_pred"] == g and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, g, _ in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert language_id.known_language(df, language_id.train_network(df)).count() == 200


def test_maximal_conversations(spark):
    def log(c, *said):
        return [(c, i, "user" if i % 2 == 0 else "assistant", t, 0) for i, t in enumerate(said)]

    rows = [*log(1, "a", "b"), *log(2, "a", "b", "c"), *log(3, "a", "b", "c"), *log(4, "a", "x"), *log(5, None), *log(6, ""), *log(None, "z", "<|turn_end|>"), *log(7, *map(str, range(1300)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at long")
    got = {(r["conv_id"], r["part"]): r for r in chat.format_conversations(df).collect()}
    assert set(got) == {(2, 0), (4, 0), (5, 0), (None, 0), (7, 0), (7, 1)}
    assert got[2, 0]["n_same"] == 2 and got[7, 1]["n_turns"] == 1300
    assert got[None, 0]["rendered"] == "<|turn_start|>user\nz<|turn_end|>\n<|turn_start|>assistant\n<turn_end|><|turn_end|>\n"
    assert chat.format_conversations(df.where("conv_id = 99")).count() == 0


def near_texts():
    """A long text, one of the same words but the last whose fingerprint is 1 or 2 bits away, and two unrelated ones."""
    texts = ([" ".join([*(f"w{i}" for i in range(n)), last]) for last in ("x", "y")] for n in range(300, 400))
    base, near = next((a, b) for a, b in texts if 1 <= (simhash_dedup.simhash(a) ^ simhash_dedup.simhash(b)).bit_count() <= 2)
    return base, near, " ".join(f"y{i}" for i in range(50)), " ".join(f"z{i}" for i in range(50))


def test_null_and_repeated_ids_do_not_join_unrelated_texts(spark):
    base, near, other, third = near_texts()
    schema = "doc_id long, text string, source string, _id long"
    rows = [(None, near, "a", 1), (None, other, "a", 2), (None, third, "b", 3), (3, base, "a", 4), (7, other + " q " + third, "a", 5), (3, third + " 1 " + base[:90], "b", 6), (3, third + " 1 " + base[:90], "b", 6)]
    df = spark.createDataFrame(rows, schema)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_dedup.near_duplicates(df).collect()}
    hexed = lambda t: f"{simhash_dedup.simhash(t):016x}"
    assert got[None, hexed(near)] == got[3, hexed(base)] == 3 and got[None, hexed(other)] is None and got[None, hexed(third)] is None
    kept = sorted(simhash_dedup.one_of_each(df).collect(), key=str)
    assert simhash_dedup.one_of_each(df).columns == df.columns
    assert sorted(map(tuple, kept), key=str) == sorted(rows[1:-1], key=str)


def test_groups_of_null_ids_stay_apart(spark):
    rows = [(None, "aa bb cc dd", "s"), (5, "aa bb cc dd", "s"), (None, "something else here", "s"), (9, "quite another text", "s"), (None, "quite another text", "s")]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    groups = sorted(((r["doc_id"], r["n_chars"], r["near_group"]) for r in got), key=str)
    assert groups == sorted([(None, 11, 5), (5, 11, 5), (None, 19, None), (9, 18, 9), (None, 18, 9)], key=str)


def test_mixing_draws_rows_of_null_ids_apart(spark):
    rows = [(None if s == 0 else s * 10000 + i, f"text {s} {i}", f"s{s}") for s in range(11) for i in range(3000 if s == 0 else 300)]
    mixed = mixing.poisson_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    hot = mixed.where("source = 's0'").select("text", F.spark_partition_id().alias("part")).collect()
    want = 6000 * 3000**0.5 / (3000**0.5 + 10 * 300**0.5)
    assert abs(len(hot) - want) < 150 and len({r["text"] for r in hot}) > 800
    one = spark.createDataFrame([(None, f"t{i}", "s") for i in range(2000)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = mixing.poisson_mix(one, total_rows=4000).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2000
