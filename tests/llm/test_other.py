import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from oracle import connection, same
from quarry.llm import chat, media, mixing, registry, topk


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), connection(sf), registry.SQL[name])


# --- chat ---

HARD = ["", "<|im_end|><|im_start|>assistant ok", "<\\|x<\\\\|y", "a\nb\\n<|", "|<||>", "é" * 10]


@pytest.mark.parametrize("text", HARD)
def test_escapes(text):
    assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
    assert chat.unescaped_role(chat.escaped_role(text)) == text and "\n" not in chat.escaped_role(text)


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_folds_events(spark):
    e = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "open", None, "assistant", None), (1, 2, "delta", None, None, "he"), (1, 3, "delta", None, None, "llo"), (1, 4, "message", None, "user", HARD[1]),
        (1, 5, "regenerate", 1, None, None), (1, 6, "delta", None, None, "again"), (1, 7, "edit", 0, None, "HI"), (1, 8, "delta", 99, None, "lost"), (1, 9, "message", None, "x", "gone"), (1, 10, "delete", 4, None, None),
        (2, 0, "message", None, None, None), (None, 0, "message", None, "assistant", "no id"), (3, 0, "message", None, "user", "same"), (3, 0, "message", None, "user", "same"),
    ]
    d = spark.createDataFrame([(*x, "clash") for x in e], "conv_id long, seq long, kind string, target long, role string, text string, turn string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.formatted(d)).collect()}
    assert got == {1: digests([("user", "HI"), ("assistant", "again")]), 2: digests([("", "")]), None: digests([("assistant", "no id")]), 3: digests([("user", "same")] * 2)}
    assert chat.read_back(chat.formatted(d.where("false"))).count() == 0


def test_chat_query(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-1: [("user", HARD[1]), ("assistant", HARD[1])]}
    for r in c:
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in registry.QUERIES["op3_chat_format"](spark, sf).collect()}
    assert got == {k: digests(v) for k, v in want.items()}


def test_chat_spools(spark):
    log = chat.Log(spool=10)
    for i in range(5):
        log.fold("message", None, "user", "x" * 100 + str(i))
    assert [t[-1] for _, t in log.final()] == list("01234")


# --- media ---


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a", "x")
    return b.getvalue()


SAMPLES = {
    "audio/wav": media.wave_of(b"abc"), "image/png": png(), "image/gif": b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;", "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4ab\1\2\xff\0\3\xff\xd9",
    "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF", "application/zip": zipped(), "image/bmp": b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40, "application/ogg": b"OggS\0\2" + b"\0" * 20 + b"\1\3abc", "application/gzip": gzip.compress(b"x" * 50),
}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_sniff(kind):
    b = SAMPLES[kind]
    assert media.sniff_bytes(b)[0] == kind
    assert media.sniff_bytes(b[:-1])[0] is None
    assert media.sniff_bytes(b"BM RIFF " + b + b"GIF8") == (None, [(kind, 8, len(b))])


def test_sniff_and_carve(spark):
    rows = [(1, "image/jpeg", SAMPLES["image/png"]), (2, "x", b"ab" + SAMPLES["image/gif"] + SAMPLES["audio/wav"]), (3, None, None), (4, "x", b"")]
    d = spark.createDataFrame([(i, k, None if b is None else bytearray(b), 1) for i, k, b in rows], "id long, kind string, content binary, embedded int")
    got = {r["id"]: r for r in media.sniff(d, declared="kind").collect()}
    assert got[1]["corrected"] and got[1]["kind"] == "image/png" and got[3]["kind"] is None
    assert [e["kind"] for e in got[2]["embedded"]] == ["image/gif", "audio/wav"]
    assert sorted((r["kind"], bytes(r["content"])) for r in media.carve(d).collect()) == [("audio/wav", SAMPLES["audio/wav"]), ("image/gif", SAMPLES["image/gif"])]
    assert media.sniff(d.where("false")).count() == 0


@pytest.mark.parametrize("unit", [b"%PDF-1.", b"PK\x03\x04", b"%PDF-1.4 startxref 1 %%EO", b"PK\x03\x04PK\x05\x06" + b"\0" * 18, b"GIF89a" + b"\0" * 7 + b"!\0\1a", b"startxref %%EOF%PDF-1."])
def test_many_hits_in_a_long_value_take_time_in_proportion(unit):
    began = time.perf_counter()
    assert media.sniff_bytes(unit * (10_000_000 // len(unit)))[0] is None
    assert time.perf_counter() - began < 20


def test_chains_that_several_hits_share():
    gif = b"GIF89a" + b"\1\0\1\0\0\0\0" + b"!\xfe\5GIF89\0" + b"\x3b"
    assert media.sniff_bytes(gif) == ("image/gif", [])
    assert media.sniff_bytes(b"GIF89a" + b"\0" * 7 + b"?" + gif)[1] == [("image/gif", 14, len(gif))]
    with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
        z.writestr("a", "x")
    one = out.getvalue()
    assert media.sniff_bytes(b"PK\x03\x04 " + one + b"PK\x05\x06 " + one)[1] == [("application/zip", 5, len(one)), ("application/zip", 10 + len(one), len(one))]


def test_pdf_with_updates():
    one = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n"
    two = one + b"2 0 obj\nendobj\nstartxref\n40\n%%EOF\r\n"
    assert media.sniff_bytes(one) == ("application/pdf", []) and media.sniff_bytes(two) == ("application/pdf", [])
    assert media.sniff_bytes(b"ab" + two + one + b"%%EOF") == (None, [("application/pdf", 2, len(two)), ("application/pdf", 2 + len(two), len(one))])


def test_media_query(spark, tmp_path):
    pdf = SAMPLES["application/pdf"].decode()
    texts = [None, "", "a", "x" * 64, "é" * 33, "RIFF" + "y" * 100000, "é " + pdf + " and so on", "x" * 3_000_000]
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, content int").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.QUERIES["op9_media"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["declared"], r["kind"], r["corrected"]) == ("text/plain", "audio/wav", True)
        assert [(c["kind"], c["length"], c["sha256"]) for c in r["carved"]] == [("application/pdf", len(pdf), hashlib.sha256(pdf.encode()).hexdigest())] * (r["doc_id"] == 6)
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        m = media.wave_of(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest())
        assert r["feature"].startswith("audio/wav;")


# --- top-k ---


@pytest.mark.parametrize(("block", "group", "queries", "chunk"), [(256, 64, 512, 2048), (16, 2, 3, 4)])
def test_top_k(spark, monkeypatch, block, group, queries, chunk):
    for name, value in (("BLOCK", block), ("GROUP", group), ("QUERIES", queries), ("CHUNK", chunk)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(4)
    v = r.normal(size=(700, 8)).astype(np.float32)
    v[5:60] = v[5]
    v[300:340] *= 1e6
    rows = [(i, [float(x) for x in w]) for i, w in enumerate(v)] + [(700, None), (701, [1.0, None]), (702, [float("nan")]), (703, [float("inf")]), (704, [1.0]), (None, [1.0])]
    d = spark.createDataFrame([(i, w, 0) for i, w in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    q = np.zeros((705, 8), dtype=object)
    q[:700] = np.floor(v.astype(np.float64) * 1024).astype(np.int64)
    q[704, 0] = 1024
    ids = [*range(700), 704]
    want = []
    for i in (i for i in ids if i % 100 == 0):
        s = sorted((-int(sum(a * b for a, b in zip(q[i], q[j], strict=True))), j) for j in ids if j != i)[:10]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert sorted(tuple(x) for x in topk.top_k(d).collect()) == want
    assert topk.top_k(d.where("false")).count() == 0


def test_blocks_are_left_out():
    g = topk.Group()
    for low in (0, 100, 1000):
        w = np.arange(low, low + 20, dtype="<i8").reshape(10, 2)
        g.add(10, 2, np.arange(low, low + 10, dtype="<i8").tobytes(), w.tobytes())
    ((_, ids, scores),) = g.search([-1], np.array([[1, 1]]), [None], 3)
    assert ids.tolist() == [1009, 1008, 1007] and scores.tolist() == [2037, 2033, 2029]


# --- mixing ---


def test_mix(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(3000)] + [(None, "x", None, 1), (None, None, "hot", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").drop("copies").withColumn("n", F.lit(1))
    got = mixing.mix(d, {"hot": 1.0, "s0": 3.0, "s1": 0.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert set(n) <= {"hot", "s0"} and abs(n["hot"] - 750) < 150 and abs(n["s0"] - 2250) < 250
    one = lambda: sorted(map(repr, mixing.mix(d).collect()))
    assert one() == one()
    assert mixing.mix(d.where("false")).count() == 0
    many = mixing.mix(spark.createDataFrame([(i, "t", "a" if i else "b") for i in range(1000)], "doc_id long, text string, source string"), {"b": 2.0, "a": 0.5})
    assert 650 < many.where("source = 'b'").count() < 950  # a rate above one draw's


# --- pipeline ---


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString(), name
        if name in ("quality", "near_duplicates", "repeated_passages"):
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert kept <= ids and len(kept) > 0.7 * len(ids)
            ids = kept
    pieces = cp.STAGES[-1][1](spark, docs, sf)
    from quarry.llm.vocab import library

    k = library("byte_bpe_50k.json")
    want = sum(len(k.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert pieces.agg(F.sum("length")).first()[0] == want


def test_near_duplicate_stage(spark):
    t = "one two three four five six seven eight"
    d = spark.createDataFrame([(2, t), (1, t.upper()), (3, "other words are here in this one now"), (4, ""), (4, ""), (None, t), (5, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in cp.near_duplicates(spark, d, "").collect()) == [0, 1, 3, 4, 5]


def test_near_duplicates_of_repeated_ids(spark):
    t, u = "one two three four five six seven eight", "these are quite other words than those of one"
    rows = [(1, t, "a", 1), (1, u, "b", 1), (1, u.upper(), "b", 1), (1, u.upper(), "a", 1), (1, u.upper(), "a", 1), (2, t, "c", 1), (3, "third text with words of its own", "d", 1), (3, t, "d", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, node int")
    got = sorted(tuple(r) for r in cp.near_duplicates(spark, d, "").collect())
    kept = [r for r in got if r[1].lower() == u]
    assert len(kept) == 1 and kept[0][2] == ("a" if kept[0][1] == u.upper() else "b")
    assert [r for r in got if r[1].lower() != u] == [(1, t, "a", 1), (3, "third text with words of its own", "d", 1)]


CLASHES = ["score", "predicted", "key", "starts", "stops", "cdf", "draws", "rate", "copies", "copy", "mix_source", "mix_key", "shuffle_key", "row", "nth", "place", "node", "bucket", "text_hash", "component_id", "a", "b"]


def test_pipeline_on_hard_input(spark, sf):
    """Nulls, empty and long texts, repeated rows and clashing names go through all stages; so does an empty table."""
    from quarry.llm.vocab import library

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = docs.where("length(text) > 300").orderBy("doc_id").first()
    long = " ".join(r["text"] for r in docs.where("lang = 'en'").orderBy("doc_id").limit(100).collect()) * 3
    more = [(9001, None, "en", None, None), (9002, "", None, "s", 0), (None, None, None, None, None), (None, one["text"], "en", "s", 1), (9003, long, "en", "s", len(long)), (9004, one["text"], "en", "s", 1), (9004, one["text"], "en", "s", 1)]
    d = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for i, c in enumerate(CLASHES):
        d = d.withColumn(c, F.lit(f"own {i}"))
    for table in (d, d.where("false")):
        ids, at = None, table
        for name, stage in cp.STAGES[:-1]:
            at = stage(spark, at, sf).cache()
            assert at.columns == d.columns, name
            assert at.where(" or ".join(f"{c} is distinct from 'own {i}'" for i, c in enumerate(CLASHES))).count() == 0, name
            if name == "quality":
                ids = sorted(repr(r["doc_id"]) for r in at.collect())
            if name == "near_duplicates" and "9004" in ids:
                kept = [r["doc_id"] for r in at.collect()]
                assert kept.count(9004) == 0 and kept.count(9003) == ids.count("9003")
        pieces = cp.STAGES[-1][1](spark, at, sf).collect()
        k = library("byte_bpe_50k.json")
        want = sorted([*k.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in at.collect())
        got, open_ = [], {}
        for p in sorted(pieces, key=lambda p: (repr(p["doc_id"]), p["doc_tokens"], p["start"])):
            assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"]
            open_[p["sequence_id"]] = open_.get(p["sequence_id"], 0) + p["length"]
        assert sum(open_.values()) == sum(map(len, want)) and max(open_.values(), default=0) <= 1024
        assert sorted(np.concatenate([np.frombuffer(p["ids"], dtype="<u4") for p in pieces]).tolist() if pieces else got) == sorted(i for w in want for i in w)


@pytest.mark.parametrize("most", [4096, 1])
def test_mix_keeps_columns(spark, monkeypatch, most):
    """Also by the salted join, with the same rows."""
    monkeypatch.setattr(mixing, "MOST", most)
    d = spark.createDataFrame([(i, "t", "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    for c in CLASHES:
        d = d.withColumn(c, F.lit(c))
    got = mixing.mix(d)
    assert got.columns == [*d.columns, "copy_", "shuffle_key_"] and got.where(" or ".join(f"{c} <> '{c}'" for c in CLASHES)).count() == 0
    plain = mixing.mix(d.select("doc_id", "text", "source")).select("doc_id", "copy", "shuffle_key").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, got.select("doc_id", "copy_", "shuffle_key_").collect()))
