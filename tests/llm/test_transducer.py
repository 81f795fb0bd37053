"""Operator 12 against the library, in blocks of any size, and the bounds of what waits."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.transducer import OPEN, Decoder, Encoder, Merger, decode, decoded, encode, encoded, op12_bpe_round_trip, sufficient_lookahead, tables
from quarry.llm.vocab import library

K = "byte_bpe_50k.json"
ALPHABET = "aé \n\t'sre!?12中١\x1c\x85　ʼ½<|>lvedmtbcdÀÇñ "
MARK = "<|endoftext|>"


def ids(text):
    return library(K).encode(text, add_special_tokens=False).ids


def streamed(text, sizes):
    e, out, at = Encoder(), [], 0
    while at < len(text):
        n = next(sizes)
        out.append(e.feed(text[at : at + n]))
        at += n
    return np.frombuffer(b"".join([*out, e.finish()]), dtype="<u4").tolist()


def texts(seed, n, longest=40):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) if r.random() > 0.03 else MARK for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_lookahead_of_small_lists():
    assert sufficient_lookahead([(b"a", b"b")]) == 1
    assert sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2  # a waits to see whether b goes to c
    assert sufficient_lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 3
    with pytest.raises(ValueError):
        sufficient_lookahead([(b"ab", b"c")])
    assert 100 < tables().lookahead < 1000


@pytest.mark.parametrize("seed", range(4))
def test_streams_in_any_blocks_give_the_librarys_ids(seed):
    r = random.Random(seed)
    sizes = iter(lambda: r.choice([1, 1, 2, 3, 5, 17]), None)
    for s in texts(seed, 400):
        assert streamed(s, sizes) == ids(s), s
        assert decode(np.frombuffer(encode(s, fed=3), dtype="<u4"), fed=2) == s


def test_open_runs_of_every_class():
    r = random.Random(9)
    runs = ["a" * 9001, "x" * 5000 + "1" * 7000 + "!" * 6000, " " * 9000 + "b", " " * 9000, "\n" * 5000 + " " + "c" * 6000, "é" * 4000 + "'s" * 3000, " " + "=" * 9000 + "'re" + " \t" * 4000 + "\n\n z", "中" * 5000 + MARK + "2" * 5000 + "<|endof"]
    runs += ["".join(r.choice(["the", "ing", "ation", "DRAG", "ON", "Ghost", "un", "o"]) for _ in range(3000)) for _ in range(3)]
    for s in runs:
        sizes = iter(lambda: r.choice([1, 700, 3000, 5000]), None)
        assert streamed(s, sizes) == ids(s), s[:30]


def test_what_waits_is_bounded():
    t = tables()
    for s in ("a" * 300_000, " " * 300_000, "=-" * 150_000, "the dragon " * 30_000, "\n " * 150_000, "the" * 100_000):
        e = Encoder()
        for i in range(0, len(s), 1000):
            e.feed(s[i : i + 1000])
            assert e.held() <= OPEN + 1000 + t.block + len(MARK), s[:10]


def test_tokens_leave_only_when_no_continuation_changes_them():
    r = random.Random(3)
    t = tables()
    pieces = [x.decode("latin-1") for x in t.bytes[256:50256] if x.isalpha()]
    for _ in range(60):
        s = "".join(r.choice(pieces) for _ in range(1500))[:6000].encode("latin-1")
        m = Merger(t)
        early = [i for k in range(0, len(s), 97) for i in m.feed(s[k : k + 97])]
        assert early + m.close() == t.merge(s)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30), st.integers(1, 5))
def test_any_ids_decode_as_the_library_does(some, n):
    d = Decoder()
    got = "".join([*(d.feed(some[i : i + n]) for i in range(0, len(some), n)), d.finish()])
    assert got == library(K).decode(some, skip_special_tokens=False)


def test_broken_bytes_decode_as_the_library_does():
    r = random.Random(5)
    odd = [i for i, b in enumerate(tables().bytes) if any(c >= 0x80 for c in b)]
    for _ in range(3000):
        some = [r.choice(odd) for _ in range(r.randint(0, 7))]
        d = Decoder()
        assert "".join([*(d.feed([i]) for i in some), d.finish()]) == library(K).decode(some, skip_special_tokens=False), some


def test_frames(spark):
    values = [None, "", "a", "don't stop  now\n\n " + MARK, "x" * 70_000, "the same", "the same"]
    docs = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)] + [(None, "no id", "clash")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in decoded(encoded(docs)).collect()}
    assert len(got) == len(values) + 1
    for i, v in [*enumerate(values), (None, "no id")]:
        assert np.frombuffer(got[i].ids, dtype="<u4").tolist() == ids(v or "")
        assert (got[i].text, got[i].n_tokens) == (v or "", len(ids(v or "")))
    assert decoded(encoded(docs.limit(0))).count() == 0


def test_the_query_equals_the_library(spark, sf):
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        x = ids(r.text or "")
        back = library(K).decode(x, skip_special_tokens=False)
        want.add((r.doc_id, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert set(map(tuple, op12_bpe_round_trip(spark, sf).collect())) == want
