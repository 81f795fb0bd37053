import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import packing, token_counts, token_file
from quarry.llm.runtime import written
from quarry.llm.vocab import byte_encoder, library, word_encoder

ALPHABET = "aé \n\t'sre!?12中١\x1c\x85　ʼ½<|>lvedmtbcdÀÇñ"
TEXTS = [None, "", "a", "don't stop  now\n\n 'tis <|endoftext|> the end <|endof", "x" * 3000, " " * 500 + "b", "the same text", "the same text", "Émile\n\nétait là. " * 300]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) if r.random() > 0.03 else "<|endoftext|>" for _ in range(r.randint(0, 16))) for _ in range(n)]


def documents(spark, values=TEXTS):
    rows = [(i, t, "clash") for i, t in enumerate(values)] + [(None, "no id", "clash"), (3, values[3], "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_every_prefix_has_the_librarys_count():
    c, k = token_counts.counter(), library("byte_bpe_50k.json")
    for s in texts(1, 400):
        got = c.table(s)
        assert got.tolist() == [len(k.encode(s[: i + 1], add_special_tokens=False).ids) for i in range(len(s))], s


@pytest.mark.parametrize(("encoder", "name"), [(byte_encoder, "byte_bpe_50k.json"), (word_encoder, "word_bpe_49k.json")])
def test_encoders_give_the_librarys_ids(encoder, name):
    e, k = encoder(), library(name)
    for s in texts(2, 4000) + [t for t in TEXTS if t]:
        assert e.encode(s).tolist() == k.encode(s, add_special_tokens=False).ids, s


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoders_on_any_text(s):
    assert byte_encoder().encode(s).tolist() == library("byte_bpe_50k.json").encode(s, add_special_tokens=False).ids
    assert token_counts.counter().table(s)[-1:].tolist() == [len(library("byte_bpe_50k.json").encode(s, add_special_tokens=False).ids)][: len(s)]


def test_token_counts(spark):
    k = library("byte_bpe_50k.json")
    got = token_counts.token_counts(documents(spark), keep_table=True)
    d = {r["doc_id"]: r for r in documents(spark).collect()}
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = d[r["doc_id"]]["text"] or ""
        n = len(k.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    cut = got.where("doc_id = 8").select(token_counts.longest_prefix("prefix_counts", F.lit(100)).alias("c"), token_counts.tokens_at("prefix_counts", F.lit(50)).alias("t")).first()
    assert len(k.encode(TEXTS[8][: cut["c"]], add_special_tokens=False).ids) <= 100 < len(k.encode(TEXTS[8][: cut["c"] + 1], add_special_tokens=False).ids)
    assert cut["t"] == len(k.encode(TEXTS[8][:50], add_special_tokens=False).ids)
    assert token_counts.token_counts(documents(spark).where("false")).count() == 0


def check_packing(spark, docs):
    k = library("byte_bpe_50k.json")
    want = sorted(k.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect())
    pieces = packing.pack(docs).collect()
    bins, parts = {}, {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        parts.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["ids"]))
    used = 0
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
        used += at
    assert sum(len(w) for w in want) == used
    return pieces, bins, want, parts


def test_packing(spark):
    docs = documents(spark).where("doc_id is not null and doc_id <> 3")
    _, _, want, parts = check_packing(spark, docs)
    whole = []
    for (_, n), ps in parts.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(ps)), dtype="<u4").tolist()
        assert len(ids) == n
        whole.append(ids)
    assert sorted(whole) == want
    check_packing(spark, documents(spark))
    assert packing.pack(docs.where("false")).count() == 0


def test_packing_pads_little(spark, sf):
    _, bins, want, _ = check_packing(spark, spark.read.parquet(f"{sf}/documents.parquet").coalesce(1))
    padded = sum(packing.padded_length(sum(n for _, n in b)) for b in bins.values())
    assert padded <= 1.02 * sum(map(len, want))


def test_cuts():
    for n in range(1, 4000):
        assert sum(packing.cuts(n)) == n and all(0 < c <= 1024 for c in packing.cuts(n))


def test_wavelet_matrix():
    r = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = r.choice(np.array([0, 1, 5, 49407, 65535, 300], dtype=np.uint16), n)
        m = token_file.WaveletMatrix.of(ids)
        assert m.ids().tolist() == ids.tolist()
        for i in r.integers(0, n, 20).tolist() if n else []:
            assert m.access(i) == ids[i]
            assert m.rank(300, i) == int((ids[:i] == 300).sum())
        at = np.flatnonzero(ids == 5).tolist()
        assert [m.select(5, k) for k in range(min(9, len(at)))] == at[:9]
        with pytest.raises(IndexError):
            m.select(5, len(at))


def test_token_file(spark):
    docs = documents(spark)
    k = library("word_bpe_49k.json")
    file = written(token_file.shards(docs, shard_tokens=400), "t")
    got = token_file.read_documents(file).join(token_file.shard_starts(file), ["part", "shard"]).collect()
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    want, at = [], 0
    for r in order:
        ids = k.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((at, r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted((r["before"] + r["within"], r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got) == want
    same = library("word_bpe_49k.json").encode("same", add_special_tokens=False).ids[0]
    assert token_file.token_frequency(file, same).first()["n"] == 2
    assert {(r["doc_id"], r["position"]) for r in token_file.occurrences(file, same).collect()} == {(6, 1), (7, 1)}
    assert token_file.shards(docs.where("false")).count() == 0


HARD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x" * 200_000), (5, "Émile\n\n  <|endoftext|> 'tis <|im_end|> été " * 2000), (6, " "), (7, "\t\n 中文 words"), (8, "same"), (9, "same")]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame([(i, t, 0, 0) for i, t in HARD], "doc_id long, text string, ids int, n_bytes int").repartition(2).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("source", ["hard", "sf"])
def test_queries_equal_the_library(spark, request, source):
    """op4, op6 and op10 as registered, on whole tables, against the library by rows."""
    from quarry.llm import registry

    folder = request.getfixturevalue(source)
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    byte, word = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    ids = [(d, t, byte.encode(t, add_special_tokens=False).ids) for d, t in docs]
    got = sorted(tuple(r) for r in registry.QUERIES["op4_token_counts"](spark, folder).collect())
    assert got == sorted((d, len(t.encode()), len(x), len(x) > 512) for d, t, x in ids)

    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    pieces, room, want = registry.QUERIES["op6_packing"](spark, folder).collect(), {}, {}
    for d, _, x in ids:
        want.setdefault((d, len(x) + 1), []).append([*x, 0])
    parts = {}
    for p in pieces:
        whole = want[p["doc_id"], p["doc_tokens"]][0]
        assert p["ids_crc32"] == crc(whole[p["start"] : p["start"] + p["length"]])
        parts.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"]))
        room.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(x for x in packed_once(k[1]) for _ in v) for k, v in want.items()}
    for b in room.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024

    at, want = 0, []
    for d, t in docs:
        x = [*word.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, at, len(x), crc(x)))
        at += len(x)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.QUERIES["op10_token_file"](spark, folder).collect()) == want


def packed_once(n):
    """Where a document of n ids is cut."""
    start = 0
    for length in packing.cuts(n):
        yield start, length
        start += length
