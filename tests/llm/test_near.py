import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import jaccard, quality, repeats
from quarry.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def sets(docs, width):
    out = []
    for _, t in docs:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def brute(docs, width, percent):
    s = sets(docs, width)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if docs[i][0] is not None and docs[j][0] is not None and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(seed=1):
    r = random.Random(seed)
    passage = r.choices(WORDS, k=40)
    docs = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one TWO"), (5, "É one"), (6, "é one"), (None, "one two"), (3, "one two")]
    n = 10
    for _ in range(25):  # groups of near copies, some of them chains
        base = r.choices(WORDS, k=r.randint(8, 120))
        for _ in range(r.randint(1, 6)):
            docs.append((n, r.choice(["  ", " ", "\n"]).join(base)))
            n += 1
            for _ in range(r.choice([0, 1, 2, 3])):
                base[r.randrange(len(base))] = r.choice(WORDS)
    for _ in range(30):  # documents that share a passage
        docs.append((n, " ".join(r.choices(WORDS, k=r.randint(0, 30)) + passage + r.choices(WORDS, k=r.randint(0, 30)))))
        n += 1
    docs.append((n, " ".join(r.choices(WORDS, k=20000))))
    for size in (150, 260, 600):  # copies of one text with more and more changes, up to and beyond the threshold
        base = r.choices([f"v{i}" for i in range(5000)], k=size)
        for k in range(14):
            copy = list(base)
            for at in r.sample(range(size), k * size // 300 + k % 3):
                copy[at] = r.choice(WORDS)
            n += 1
            docs.append((n, " ".join(copy)))
    return docs


@pytest.mark.parametrize(("width", "percent", "stars", "few", "levels", "hot"), [(4, 85, 2, 64, 4, 1 << 24), (5, 80, 0, 3, 2, 3000), (5, 80, 1, 2, 5, 1 << 24), (4, 85, 0, 2, 1, 800)])
def test_jaccard_classes(spark, monkeypatch, width, percent, stars, few, levels, hot):
    docs = corpus()
    monkeypatch.setattr(jaccard.shared_entries, "__defaults__", (hot,))
    monkeypatch.setattr(jaccard, "MORE", 1 if few < 64 else 16)
    monkeypatch.setattr(jaccard, "CARRIED", 12 if few == 2 else 256)
    monkeypatch.setattr(jaccard.small, "__defaults__", (0 if few == 2 else 1_000_000,))  # joins by shuffle
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, node int").repartition(4)
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(d, width, percent, stars, few, levels).collect()], key=repr)
    assert got == brute(docs, width, percent)


def near(n, seed=5):
    """Copies of one text of 200 words, each with some words changed."""
    r = random.Random(seed)
    base = r.choices([f"b{i}" for i in range(3000)], k=200)
    docs = []
    for i in range(n):
        copy = list(base)
        for at in r.sample(range(200), 3 + i % 3):
            copy[at] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    return docs


def test_pairs_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """A group of copies that are near, but not linked, does not give all its pairs."""
    counts = []

    def tables(df, name, codec="zstd", own=jaccard.written):
        out = own(df, name, codec)
        if name in ("open", "stars", "tried"):
            counts[-1] += out.count()
        return out

    monkeypatch.setattr(jaccard, "written", tables)
    for n in (150, 300):
        docs = near(n)
        counts.append(0)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), few=16).collect())
        assert got == sorted(brute(docs, 4, 85))
    assert counts[1] <= 2.5 * counts[0] and counts[1] < 300 * 20


def templates(n, seed=9, slots=40, variants=2):
    """Texts of 3,000 words from one template, of which each slot of 15 words has some variants: most pairs are just below the threshold."""
    r = random.Random(seed)
    words = [f"t{i}" for i in range(100_000)]
    fixed = [r.choices(words, k=60) for _ in range(slots)]
    filled = [[r.choices(words, k=15) for _ in range(variants)] for _ in range(slots)]
    return [(i, " ".join(w for f, v in zip(fixed, filled, strict=True) for w in f + r.choice(v))) for i in range(n)]


@pytest.mark.parametrize("n", [150, 300])
def test_long_texts_of_one_template(spark, monkeypatch, n):
    """Differences of hundreds of elements, but few classes: only few pairs more than the links themselves are tried."""
    opened = []

    def tables(df, name, codec="zstd", own=jaccard.written):
        out = own(df, name, codec)
        if name == "open":
            opened.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", tables)
    docs = templates(n)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), few=16).collect())
    assert got == sorted(brute(docs, 4, 85))
    assert 1 < len({c for _, _, c in got}) < n and sum(opened) <= 20 * n


@pytest.mark.parametrize("carried", [2, 256])
def test_classes_of_differences(monkeypatch, carried):
    """What two differences share is never held to be less than it is, also where classes are not all carried or are dealt to several tokens."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "HEAVIEST", 3)
    r = random.Random(carried)
    keys = {k: set() for k in range(1, 9)}
    for start in range(0, 600, 6):
        within = r.sample(sorted(keys), r.randint(2, 5))
        for t in range(start, start + r.randint(1, 6)):
            for k in within:
                keys[k].add(t)
    nodes = {t: [k for k in keys if t in keys[k]] for t in range(600)}
    mark = {t: hash(tuple(v)) for t, v in nodes.items()}
    rows = [(k, 40, t, len(nodes[t]), mark[t]) for k in keys for t in sorted(keys[k])]
    names = ["node", "n", "token", "df", "mark"]
    got = drive(jaccard._two_prefixes(carried), pa.table({c: pa.array([x[i] for x in rows], pa.int64()) for i, c in enumerate(names)}), 50).to_pylist()
    assert [x["key"] for x in got] == sorted(keys) and all(x["shared"] == len(keys[x["key"]]) for x in got)
    for x, y in combinations(got, 2):
        both = len(keys[x["key"]] & keys[y["key"]])
        bound = sum(t & 3 for t in set(x["every"]) & set(y["every"])) + max(x["rest"], y["rest"])
        assert bound >= both
        if both >= 40:
            assert set(x["tokens"]) & set(y["tokens"])
            assert x["second"] is None or y["second"] is None or set(x["second"]) & set(y["second"])


def test_words_of_equal_sums_are_told_apart(spark):
    """Strings on which polynomial sums modulo a power of two agree."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(1, a), (2, a.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard.jaccard_classes(d).collect()) == [1, 2]


def test_jaccard_on_nothing(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}


def brute_repeats(docs, depth):
    seen = {}
    raws = [(t or "").encode() for _, t in docs]
    for b in raws:
        for j in range(len(b) - depth + 1):
            seen[b[j : j + depth]] = seen.get(b[j : j + depth], 0) + 1
    out = []
    for (d, _), b in zip(docs, raws, strict=True):
        gone = np.zeros(len(b), dtype=bool)
        for j in range(len(b) - depth + 1):
            if seen[b[j : j + depth]] > 1:
                gone[j : j + depth] = True
        import hashlib

        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def repeating(seed):
    r = random.Random(seed)
    base = "".join(r.choice("abé ") for _ in range(400))
    noise = lambda n: "".join(r.choice("ab ") for _ in range(r.randint(0, n)))
    docs = [(None, base[:80]), (0, None), (1, ""), (2, "ab" * 60), (3, "é" * 100), (4, base), (4, base)]
    for i in range(60):
        x = r.randint(0, 300)
        docs.append((10 + i, r.choice([noise(200), noise(60) + base[x : x + r.randint(10, 100)] + noise(60), base[: r.randint(0, 400)]])))
    return docs


@pytest.mark.parametrize(("depth", "broadcast"), [(25, 1_000_000), (60, 0)])
def test_repeats(spark, monkeypatch, depth, broadcast):
    monkeypatch.setattr(repeats, "BROADCAST", broadcast)
    docs = repeating(depth)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, key int").repartition(3)
    got = sorted([tuple(r)[:5] for r in repeats.digests(d, depth).collect()], key=repr)
    assert got == brute_repeats(docs, depth)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.digests(empty, depth).count() == 0


def test_repeats_query(spark, sf):
    """The registered query at its own depth, on a whole table."""
    from quarry.llm import registry

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op7_repeats"](spark, sf).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute_repeats(docs, 400)
    texts = dict(docs)
    assert all(r["text"] == texts[r["doc_id"]] for r in got if r["n_removed"] == 0) and any(r["n_removed"] for r in got)


def test_repeats_count_passages(spark, tmp_path):
    """Passages of over 50 words in two documents: each is counted; those of 400 bytes and more are removed, shorter ones stay."""
    from quarry.llm import registry

    r = random.Random(11)
    words = lambda n, most=7: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, most))) for _ in range(n))
    docs, planted = [], {}
    for i in range(0, 60, 2):
        passage = words(r.randint(55, 100)) if i else words(51, 3)
        planted[i] = planted[i + 1] = len(passage)
        docs += [(i + j, f"{words(r.randint(20, 90))}\n{passage}\n{words(r.randint(20, 90))}") for j in range(2)]
    docs += [(i, words(r.randint(1, 300))) for i in range(60, 100)]
    spark.createDataFrame([*docs, (100, None), (101, "")], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in registry.QUERIES["op7_repeats"](spark, str(tmp_path)).collect()), key=repr)
    assert [x[:5] for x in got] == brute_repeats([*docs, (100, None), (101, "")], 400)
    assert {x[0]: x[-1] for x in got} == {i: int(i in planted) for i in range(102)}
    assert all(x[2] > 0 for x in got if planted.get(x[0], 0) >= 400) and min(planted.values()) == planted[0] == 203
    assert not any(x[2] for x in got if planted.get(x[0], 0) < 390)


def test_jaccard_query(spark, sf):
    from quarry.llm import registry

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in registry.QUERIES["op1_jaccard_join"](spark, sf).collect()], key=repr) == brute(docs, 4, 85)


def test_hashes_of_ranges():
    r = np.random.default_rng(2)
    raw = r.integers(97, 99, 300).astype(np.uint8)
    h, a = repeats.Hashes(raw), np.arange(296)
    seen = {}
    for i, p in enumerate(zip(h.proof(a, a + 4).tolist(), h.of(a, a + 4).tolist(), strict=True)):
        assert seen.setdefault(raw[i : i + 4].tobytes(), p) == p
    assert len(set(seen.values())) == len(seen) == 16


def drive(function, table, width):
    """Feeds a map function batches of some rows each."""
    import pyarrow as pa

    return pa.Table.from_batches(list(function(iter(table.to_batches(max_chunksize=width)))))


@pytest.mark.parametrize("flush", [8, 1 << 19])
@pytest.mark.parametrize("piece", [150, 1 << 20])
def test_repeats_in_small_pieces(monkeypatch, flush, piece):
    """The same through all passes by hand, with pieces, flushes and groups that do not fit."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "FLUSH", flush)
    monkeypatch.setattr(repeats, "PIECE", piece)
    depth, docs = 25, [(i, t or "") for i, (_, t) in enumerate(repeating(3))]
    texts = pa.table({"key": pa.array([i for i, _ in docs], pa.int64()), "text": [t for _, t in docs]})
    first = drive(repeats._first_pass(depth), texts, 5).to_pandas()
    sent = first[first.gram.notna()].astype({"gram": "int64", "whole": "int64", "first": "int64", "count": "int32", "weight": "int32"}).sort_values(["gram", "whole"])
    second = drive(repeats._second_pass(depth), pa.Table.from_pandas(sent[["key", "gram", "whole", "weight", "first", "count"]], preserve_index=False), 7).to_pandas()
    rest = second[second.gram.notna()]
    lists = rest.groupby("key").agg(list)
    texts_of = dict(docs)
    third_in = pa.table({"key": pa.array(lists.index, pa.int64()), "text": [texts_of[k] for k in lists.index], "firsts": [[int(x) for x in v] for v in lists["first"]], "counts": [[int(x) for x in v] for v in lists["count"]], "weights": [[int(x) for x in v] for v in lists["weight"]]})
    third = drive(repeats._windows(depth), third_in, 3).to_pandas()
    hashed = third[third.hash.notna()].astype({"hash": "int64", "proof": "int64", "weight": "int32"}).sort_values(["hash", "proof"])
    fourth = drive(repeats._equal_windows(depth), pa.Table.from_pandas(hashed[["key", "start", "hash", "proof", "weight"]], preserve_index=False), 11).to_pandas()
    gone = {i: np.zeros(len(t.encode()), dtype=bool) for i, t in docs}
    for part in (first[first.gram.isna()], second[second.gram.isna()], third[third.hash.isna()], fourth):
        for r in part.itertuples():
            gone[r.key][int(r.start) : int(r.stop)] = True
    assert sorted((i, int(g.sum())) for i, g in gone.items()) == sorted((i, n) for i, _, n, _, _ in brute_repeats(docs, depth))


def test_deduplicated_keeps_characters_whole(spark):
    d = spark.createDataFrame([(1, "xé" + "a" * 30, "m"), (2, "yé" + "a" * 30, "n"), (3, None, "o")], "doc_id long, text string, starts string").selectExpr("*", "1 as key", "2 as stops")
    got = {r["doc_id"]: (r["text"], r["starts"]) for r in repeats.deduplicated(d, 31).collect()}
    assert got[3] == (None, "o") and got[1][0] in ("x", "xé") and got[1][0].isprintable()


def test_quality(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.learn(docs, labels, per_class=400)
    got = quality.scored(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "predicted", "quality").toPandas()
    assert len(got) > 500 and (got["predicted"] == got["quality"]).mean() > 0.98
    assert got["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x " * 50000, 0.5)], "doc_id long, text string, score double")
    assert quality.scored(odd, model).where("score between 0 and 1 and predicted in (0, 1)").count() == 3
    assert quality.scored(odd.where("false"), model).count() == 0


def test_held_out_labels_and_other_columns_do_not_count(spark):
    """Scores are of the text alone, learned from rows that are not held out, within the bounds."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    texts = [(r["text"] or "").encode() for r in docs.limit(300).collect()]
    score = lambda d, x, **o: quality.learn(d, x, **o).score(texts).tolist()
    plain = score(docs, labels)
    turned = F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    assert score(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), labels.withColumn("quality", turned)) == plain
    assert quality.learn(docs, labels).score(texts[:7]).tolist() == pytest.approx(plain[:7], abs=2e-6)
    assert quality.learn(docs, labels).score(texts[3:4]).tolist() == pytest.approx(plain[3:4], abs=2e-6)
    long = spark.createDataFrame([(10**9, "word " * 4000)], "doc_id long, text string")
    more = labels.select("doc_id", "quality").union(spark.createDataFrame([(10**9, 0)], "doc_id long, quality int"))
    bounded = quality.learn(docs.select("doc_id", "text").union(long), more, most_bytes=15_000, use=F.lit(True))
    assert all(0 <= x <= 1 for x in bounded.score([b"", *texts[:5], b"word " * 300_000]))


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, none).score([b"x"]).tolist() == [0.5]
    ones = spark.createDataFrame([(1, 1, 0), (2, None, 0), (9, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, ones).score([b"x"]).tolist() == [1.0]
    elsewhere = spark.createDataFrame([(i, i % 4 // 3, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int")
    assert 0 < quality.learn(docs, elsewhere).score([b"x"])[0] < 1
