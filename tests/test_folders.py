import os
import time

import pytest

from quarry.sources import folders
from quarry.sources import parsers as ps


@pytest.fixture
def tree(tmp_path, spark):
    folders.register(spark)
    root = tmp_path / "docs"
    for name in ("a/x.md", "a/deep/y.TXT", "b/z.md", "b/node_modules/n.md", "b/drafts/d.md", "c/empty.md", "c/pic.png", "c/file with, comma.md"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if "empty" in name else f"# {name}\nText of {name}")
    other = tmp_path / "other"
    other.mkdir()
    (other / "linked.md").write_text("# linked\nfar away")
    (root / "b" / "link").symlink_to(other)
    (root / "c" / "again").symlink_to(other)
    (root / "a" / "deep" / "up").symlink_to(root)
    (root / "a" / "nothing.md").symlink_to(root / "missing")
    (root / "c" / "one.md").symlink_to(root / "a" / "x.md")
    return root


def plain(root, dropped=(), suffixes=(".md", ".txt")):
    """The files of a walk that follows links and reads each real folder once, in the order of names."""
    out, seen = set(), set()

    def walk(folder):
        if os.path.realpath(folder) in seen:
            return
        seen.add(os.path.realpath(folder))
        for name in sorted(os.listdir(folder)):
            p = os.path.join(folder, name)
            if name in dropped:
                continue
            if os.path.isdir(p):
                walk(p)
            elif os.path.isfile(p) and os.path.splitext(p)[1].lower() in suffixes:
                out.add((p, open(p, "rb").read()))

    walk(str(root))
    return out


def found(df):
    rows = df.select("path", "content", "length").collect()
    assert all(len(r["content"]) == r["length"] for r in rows) and len({r["path"] for r in rows}) == len(rows)
    return {(r["path"], bytes(r["content"])) for r in rows}


@pytest.mark.parametrize("files", ["1", "3", "1000"])
def test_equals_a_plain_walk(spark, tree, files):
    read = spark.read.format("folder").option("suffixes", ".md,.txt").option("files", files)
    assert found(read.load(str(tree))) == plain(tree)
    assert found(read.option("exclude", "node_modules, drafts").load(f"file://{tree}")) == plain(tree, ("node_modules", "drafts"))
    assert found(read.option("exclude", "b/link,b/drafts/*,*.TXT").load(str(tree))) == {x for x in plain(tree, ("link",)) if "/drafts/" not in x[0] and not x[0].endswith("TXT")}


def test_excluded_folders_are_not_entered(spark, tree, monkeypatch):
    entered = []
    scan = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: entered.append(str(p)) or scan(p))
    list(folders.Tree({"path": str(tree), "exclude": "node_modules,a"}).folders())
    assert not [p for p in entered if "node_modules" in p or "/docs/a" in p] and str(tree / "b") in entered


def test_large_folders_are_split_and_batches_are_bounded(spark, tmp_path, monkeypatch):
    for i in range(250):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * i)
    t = folders.Tree({"path": str(tmp_path), "files": "40"})
    parts = t.parts()
    assert len(parts) == 7 and all(p.folders == [str(tmp_path)] for p in parts)
    names = [p for part in parts for p, _ in t.files(part)]
    assert len(names) == 250 == len(set(names))
    monkeypatch.setattr(folders, "BATCH", 1000)
    for part in parts:
        assert all(b.num_rows == 1 or sum(b.column(2).to_pylist()) <= 1000 for b in t.read(part))


def test_files_are_parsed_by_suffix(spark, tree):
    docs = ps.parsed(spark.read.format("folder").option("suffixes", ".md,.png").load(str(tree / "c"))).collect()
    by = {r["filename"]: r for r in docs}
    assert "Text of c/file with" in by["file with, comma.md"]["content"] and by["empty.md"]["content"] is None and by["pic.png"]["error"]


def test_empty_and_missing_folders(spark, tmp_path):
    folders.register(spark)
    assert spark.read.format("folder").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="No such file"):
        spark.read.format("folder").load(str(tmp_path / "none")).count()
    with pytest.raises(ValueError, match="path"):
        folders.Tree({})


def test_stream_gives_new_and_changed_files_and_reads_a_failed_batch_again(spark, tree, tmp_path):
    out, fail = [], [True]

    def apply(df, n):
        names = sorted(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect())
        if fail[0] and "new.md" in names:
            fail[0] = False
            raise RuntimeError("lost")
        out.extend(names)

    def run():
        stream = spark.readStream.format("folder").option("suffixes", ".md").option("settle", "0").load(str(tree / "c"))
        q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert sorted(out) == ["empty.md", "file with, comma.md", "linked.md", "one.md"]
    out.clear()
    time.sleep(0.05)
    (tree / "c" / "new.md").write_text("new")
    (tree / "c" / "empty.md").write_text("no more")
    os.utime(tree / "c" / "new.md", (1, 1))
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert sorted(out) == ["empty.md", "new.md"]
