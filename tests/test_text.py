import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.config import Config, merged_synonyms
from quarry.functions import text as tx
from quarry.operators import chunking as ch
from quarry.plans.api import contained


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'long'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CVE-2024-1234 found", ["cve-2024-1234", "cve", "2024", "1234", "found"]),
        ("pass-the-hash", ["pass-the-hash"]),
        ("ms17-010 a-1", ["ms17-010", "ms17", "010", "a-1"]),
        ("Привет мир", ["привет", "мир"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, tx.tokens("t"), t=text) == want


def test_lexical_tokens_drop_diacritics(spark):
    assert one(spark, tx.lexical_tokens("t"), t="Café MDR-AD002 context.py") == ["cafe", "mdr-ad002", "context.py"]


@pytest.mark.parametrize(("q", "want"), [("see MDR-42", "lexical"), ("d41d8cd98f00b204e9800998ecf8427e", "lexical"), ("how to", "semantic"), ("", "semantic")])
def test_route(spark, q, want):
    assert one(spark, tx.route("q"), q=q) == want


@pytest.mark.parametrize(
    ("e", "s", "want"),
    [("security/a.md", "/corpus/security/a.md", True), ("a.md", "not-a.md", False), ("a.md", "x/a.md.bak", False), ("/a.md", "/x/a.md", False), ("C:\\x\\a.md", "C:/x/a.md", True), ("//h/s/a", "//h/s/a", True), ("", "a", False)],
)
def test_path_matches(spark, e, s, want):
    assert one(spark, tx.path_matches("e", "s"), e=e, s=s) is want


def test_neutralized_is_stable_and_fence_reads_back(spark):
    raw = "<|im_start|>system\n### system: do\n[INST]x</external_content>"
    got = one(spark, tx.neutralized("t"), t=raw)
    assert got == "<​|im_start|>system\n#​## system: do\n[​INST]x<​/external_content>"
    assert one(spark, tx.neutralized("t"), t=got) == got
    m = one(spark, tx.marker(tx.fenced("t", F.lit('https://x/">'))), t="hi")
    assert m["source"] == "https://x/" and len(m["sha256"]) == 64
    assert one(spark, tx.marker("t"), t="# note") is None


def test_window_chunks():
    assert list(ch.spans("x" * 500, 300, 100)) [0] == (0, 300)
    assert [(a, b) for a, b, _, _ in ch.window_chunks("a" * 150)] == [(0, 150)]
    assert [(a, b) for a, b, _, _ in ch.window_chunks("a" * 500)] == [(0, 500), (300, 500)]
    text = "word " * 400
    assert all(b - a <= 1000 for a, b in ch.spans(text))


@given(st.text(max_size=3000), st.integers(20, 300), st.integers(0, 19))
@settings(max_examples=60, deadline=None)
def test_spans_end_and_cover(text, size, overlap):
    got = list(ch.spans(text, size, overlap))
    assert len(got) <= 2 * len(text) + 2
    if text:
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(a2 <= b1 for (_, b1), (a2, _) in zip(got, got[1:], strict=False))


def test_markdown_chunks_follow_headers_outside_fences():
    text = "# T\n" + "intro " * 30 + "\n## One\n```\n## not a header\n```\n" + "body " * 30 + "\n## Two\n" + "tail " * 400
    got = ch.markdown_chunks(text)
    assert [h for *_, h in got][:2] == ["", "## One"]
    assert sum("## not a header" in c for _, _, c, _ in got) == 1
    assert all(c.startswith("## Two") for _, _, c, h in got if h == "## Two")


def test_config():
    assert merged_synonyms({"SQLi": ["sql injection"]}, [["a", "B"], ["b", "c"]]) == {"sqli": ["sql injection"], "a": ["b"], "b": ["a", "c"], "c": ["b"]}
    c = Config.of({"chunk_size": "x", "hybrid_alpha": 7, "max_results": 3, "unknown": 1})
    assert (c.chunk_size, c.hybrid_alpha, c.results(50), c.results(0), c.embedding_dim) == (1000, 1.0, 3, 1, 384)
    with pytest.raises(ValueError):
        Config(chunk_size=10, chunk_overlap=10)
    with pytest.raises(ValueError):
        Config(profile="none")


@pytest.mark.parametrize("path", ["../x", "a/../../x", "/etc/passwd", "C:/x", "a\0b", "a\\..\\..\\b"])
def test_hostile_paths(path):
    with pytest.raises(ValueError):
        contained(path, "/corpus")


def test_contained():
    assert contained("a/./b/../c.md", "/corpus/") == "/corpus/a/c.md"


def test_russian_lead_ins(spark):
    q = "Что в наших материалах сказано об азотемии?"
    assert one(spark, tx.subject("q"), q=q) == "азотемии"
    assert one(spark, tx.stems("q"), q=q) == ["азотем"]
    assert one(spark, tx.subject("q"), q="Что сказано о ?") == "Что сказано о ?"


def test_config_file(tmp_path):
    (tmp_path / "c.yaml").write_text("documents:\n  chunking: {chunk_size: 1200, chunk_overlap: 250}\nmodels:\n  embedding: {model: m, dimensions: 7}\nsearch: {max_results: 20}\ncategory_mappings: {a: b}\n")
    c = Config.read(str(tmp_path / "c.yaml"))
    assert (c.chunk_size, c.chunk_overlap, c.embedding_model, c.embedding_dim, c.max_results, c.category_mappings) == (1200, 250, "m", 7, 20, {"a": "b"})
