"""One query per operator over the driver's tables, and its SQL.

The corpus is documents: a document's path is source/lang/doc<doc_id>.md and its vector is embeddings' row of the same number. The query log is benchmark
(item_id, text), a query's vector is embeddings' row of its number. Both conventions hold in the SQL, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical as cn
from ..functions import patterns as many
from ..functions import text as tx
from ..operators import ann, blockmax
from ..operators import chunking as ch
from ..operators import digests as dg
from ..operators import evidence as ev
from ..operators import index as ix
from ..operators import lexical as lx
from ..operators import maintenance as mt
from ..operators import retrieval as rt
from ..plans.search import HybridSearch
from ..sources import parsers as ps
from ..sources import snapshot as sn
from ..streaming import events as es
from ..tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CATEGORIES = {"src1": "alpha", "src10": "beta", "src2/": "gamma", "src1/en": "delta"}
ROUTES = [("alpha", "the", 0), ("alpha", "of the", 0), ("beta", "que", 1), ("beta", "des", 1), ("gamma", "und", 2), ("gamma", "für", 2)]
SYNONYMS = [("the", "thee", 0), ("the", "definite article", 1), ("of the", "genitive", 0), ("la", "una", 0), ("und", "and", 0), ("and", "und", 0), ("and the", "plus", 0)]
STOP, LEADS = ("the", "and"), ("what is said of ", "what about ")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path():
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md"))


def corpus(spark, sf_dir, *columns: str) -> DataFrame:
    """doc_id, content, path, filename, category and, where named, further columns."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), path().alias("path"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), *columns)
    return d.withColumn("category", tx.category("path", CATEGORIES))


def log(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def doc_index(spark, sf_dir) -> dict[str, DataFrame]:
    tokens = ix.tokenized(corpus(spark, sf_dir), "doc_id")
    p, s = ix.postings(tokens, "doc_id"), ix.corpus_stats(tokens)
    return {"tokens": tokens, "postings": p, "corpus_stats": s, "term_stats": ix.term_stats(p, s)}


def doc_blocks(spark, sf_dir) -> DataFrame:
    """The documents' postings in blocks, written once for all reads of a query."""
    return written(blockmax.blocks(ix.tokenized(corpus(spark, sf_dir), "doc_id"), "doc_id"), "blocks")


def best(spark, sf_dir, k: int) -> DataFrame:
    """query_id, rank, doc_id, score of the log's k best documents by BM25, small beside any table of documents."""
    q = log(spark, sf_dir)
    return rt.small_pool(blockmax.searched(q, doc_blocks(spark, sf_dir), k, "doc_id"), q, k)


def doc_vectors(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def probes(spark, sf_dir) -> DataFrame:
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return v.join(log(spark, sf_dir).select("query_id"), "query_id", "left_semi")


# --- SQL parts ---

WORDS = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"


def dtok(c: str) -> str:
    return rf"""flatten(list_transform(regexp_extract_all(lower({c}), '{WORDS}'), lambda t: case when contains(t, '-') and regexp_matches(t, '\d') then list_concat([t], list_filter(string_split(t, '-'), lambda x: length(x) >= 2)) else [t] end))"""


PATH = "source || '/' || lang || '/doc' || doc_id || '.md'"
CAT = f"""case when contains(lower({PATH}), 'src1/en') then 'delta' when contains(lower({PATH}), 'src10') then 'beta' when contains(lower({PATH}), 'src2/') then 'gamma' when contains(lower({PATH}), 'src1') then 'alpha' else 'general' end"""
INDEX = f"""
toks as materialized (select doc_id, {dtok("text")} as t from documents),
p as (select doc_id, len(t) as dl, unnest(t) as term from toks),
post as materialized (select doc_id, term, count(*) as tf, max(dl) as dl from p group by all),
st as materialized (select count(*) as n, avg(len(t)) as avgdl from toks),
nd as materialized (select term, count(*) as df from post group by term),
raw as materialized (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as v from nd, st),
eps as materialized (select 0.25 * avg(v) as e from raw),
idf as materialized (select term, df, case when v < 0 then e else v end as idf from raw, eps)"""
BM = f"""{INDEX},
q as (select item_id as query_id, unnest({dtok("text")}) as term from benchmark),
qt as (select query_id, term, count(*) as qtf from q group by all),
bm_all as (select query_id, doc_id, sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score
  from qt join idf using (term) join post using (term), st where idf <> 0 group by all)"""
L2 = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::double - b.embedding[i]::double) ** 2))"


def top(source: str, order: str, k: int, name: str = "rank", per: str = "query_id") -> str:
    return f"(select * from (select *, row_number() over (partition by {per} order by {order})::int as {name} from {source}) where {name} <= {k})"


BMTOP = top("bm_all", "round(score, 9) desc, doc_id", 30)
KNN = f"""knn_all as (select b.vec_id as query_id, a.vec_id as doc_id, {L2} as distance from embeddings a, embeddings b where b.vec_id in (select item_id from benchmark))"""
KNNTOP = top("knn_all", "round(distance, 9), doc_id", 30)
FUSED = f"""{BM}, {KNN},
rrf as (select query_id, doc_id, s.rank as semantic_rank, b.rank as bm25_rank, 0.5 / (60 + coalesce(s.rank, 1000)) + 0.5 / (60 + coalesce(b.rank, 1000)) as rrf_score
  from {KNNTOP} s full join {BMTOP} b using (query_id, doc_id))"""


# --- analyzers ---


@query(f"select doc_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as token_md5 from (select doc_id, {dtok('text')} as t from documents)")
def tokenize_bm25(spark, sf_dir):
    x = t(spark, sf_dir, "documents").select("doc_id", tx.tokens("text").alias("t"))
    return x.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("token_md5"))


@query(r"""select doc_id, array_to_string(list_distinct_in_order, ' ') as stems from (
  select doc_id, list_filter(s, lambda x, i: list_position(s, x) = i) as list_distinct_in_order from (
  select doc_id, list_transform(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 3 and x not in ('the', 'and')), lambda x: x[1:6]) as s from documents))""")
def stems(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.stems("text", STOP), " ").alias("stems"))


@query("""select item_id, case when starts_with(q, 'what about ') and s <> '' then s else q end as subject from (
  select item_id, case when item_id % 2 = 0 then 'what about ' || text || '?' else text end as q, trim(case when item_id % 2 = 0 then text || '?' else text end, '?!.,;:') as s from benchmark)""")
def query_subject(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("what about "), "text", F.lit("?"))).otherwise(F.col("text")).alias("q"))
    return b.select("item_id", tx.subject("q", LEADS).alias("subject"))


@query(r"""select doc_id, case when regexp_matches(h, '[A-Z]{2,}-\d+') or regexp_matches(h, 'CVE-\d{4}-\d+') or regexp_matches(h, '^[a-f0-9]{32,64}$') then 'lexical' else 'semantic' end as route
  from (select doc_id, case doc_id % 4 when 0 then md5(text) when 1 then 'see MDR-' || doc_id else text end as h from documents)""")
def route_lexical(spark, sf_dir):
    q = F.when(F.col("doc_id") % 4 == 0, F.md5("text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("see MDR-"), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", tx.route(q).alias("route"))


@query(r"""with r(category, keyword, cat_ord) as (values ('alpha', 'the', 0), ('alpha', 'of the', 0), ('beta', 'que', 1), ('beta', 'des', 1), ('gamma', 'und', 2), ('gamma', 'für', 2)),
h as (select item_id, category, cat_ord, count(*) as n from benchmark, r
  where case when contains(keyword, ' ') then contains(lower(text), keyword) else regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || keyword || '($|[^\p{L}\p{N}_])') end group by all),
b as (select item_id, category, row_number() over (partition by item_id order by n desc, cat_ord) as k from h)
select item_id as query_id, category as routed_by from benchmark left join (select * from b where k = 1) using (item_id)""")
def route_keywords(spark, sf_dir):
    return rt.keyword_route(log(spark, sf_dir), spark.createDataFrame(ROUTES, "category string, keyword string, cat_ord int"))


@query(rf"""with s(term, synonym, ord) as (values ('the', 'thee', 0), ('the', 'definite article', 1), ('of the', 'genitive', 0), ('la', 'una', 0), ('und', 'and', 0), ('and', 'und', 0), ('and the', 'plus', 0)),
q as (select item_id, lower(trim(text)) as low, {dtok("lower(trim(text))")} as t from benchmark),
k as (select item_id, unnest(list_concat([low], t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) as term, unnest(range(len(t) + 1 + greatest(len(t) - 1, 0))) as pos from q),
h as (select item_id, synonym, min(pos * 10 + ord) as place from k join s using (term) group by all)
select item_id as query_id, low || coalesce(' ' || string_agg(synonym, ' ' order by place), '') as expanded from q left join h using (item_id) group by item_id, low""")
def expand_query(spark, sf_dir):
    return rt.expansion_terms(log(spark, sf_dir), spark.createDataFrame(SYNONYMS, "term string, synonym string, ord int"))


@query(f"select doc_id, {CAT} as category from documents")
def detect_category(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "category")


@query(r"""with k as (select doc_id, text, lower(text) as low, regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') as ip from documents)
select doc_id, array_to_string(list_sort(list_distinct(list_concat(
  list_filter(['the', 'of the', 'que', 'des', 'und', 'für', 'nmap', 'burp', 'metasploit', 'wireshark', 'hydra', 'john', 'hashcat', 'gobuster', 'nikto', 'sqlmap', 'nuclei', 'ffuf', 'bloodhound', 'mimikatz', 'responder', 'crackmapexec', 'impacket'], lambda x: contains(low, x)),
  regexp_extract_all(text, '(?i)CVE-\d{4}-\d{4,}'), regexp_extract_all(text, 'T\d{4}(?:\.\d{3})?'), case when len(ip) <= 5 then ip else [] end))), ',') as keywords from k""")
def extract_keywords(spark, sf_dir):
    routes: dict[str, list[str]] = {}
    for c, k, _ in ROUTES:
        routes.setdefault(c, []).append(k)
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.keywords("text", routes), ",").alias("keywords"))


#: Patterns of the query log that are looked for at once; more are an error, as they go to every task.
MOST_PATTERNS = 100_000


@query(rf"""with w as (select regexp_extract_all(lower(text), '{WORDS}') as t from benchmark),
p as (select distinct unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) as p from w),
h as (select doc_id, p from documents, p where contains(lower(text), p))
select doc_id, count(p) as n_patterns, sum(length(p))::bigint as n_letters from documents left join h using (doc_id) group by all""")
def benchmark_terms(spark, sf_dir):
    """P6 with many patterns: how many of the query log's words and pairs of neighbouring words a document holds anywhere, and their letters in all."""
    w = tx.words(F.col("text"))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    rows = t(spark, sf_dir, "benchmark").select(F.explode(F.concat(w, pairs)).alias("p")).distinct().limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    hit = many.counted(F.lower("text"), sorted(r["p"] for r in rows))
    d = t(spark, sf_dir, "documents").select("doc_id", hit.alias("held"))
    return d.select("doc_id", F.col("held.n").alias("n_patterns"), F.when(F.col("held.n") > 0, F.col("held.letters")).alias("n_letters"))


@query(rf"""with x as (select doc_id, source || ' ' || lang || ' ' || text as q, lower(source || '/' || lang || ' ' || 'doc' || doc_id || '.md') as p from documents),
y as (select *, regexp_extract_all(lower(q), '{WORDS}') as qt, regexp_extract_all(p, '{WORDS}') as pt from x)
select doc_id, round(case when len(qt) = 0 or len(pt) = 0 then 0 else least(0.003, coalesce(list_sum(list_transform(qt, lambda w: case when list_contains(pt, w) then 0.0006 when contains(p, w) then 0.0003 else 0 end)), 0)
  + case when trim(q) <> '' and contains(p, lower(trim(q))) then 0.0012 else 0 end) end, 6)::double as boost from y""")
def path_boost(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    q = F.concat("source", F.lit(" "), "lang", F.lit(" "), "text")
    return d.select("doc_id", F.round(tx.path_boost(q, F.concat("source", F.lit("/"), "lang"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))), 6).alias("boost"))


@query(r"""with h as (select doc_id, text, substr(text, 1, 500) as h, substr(text, 301, 200) as z from documents),
a as (select *, list_transform(['\n', '. ', '? ', '! ', '; ', ' '], lambda s: case when strpos(reverse(z), reverse(replace(s, '\n', chr(10)))) > 0
  then 300 + length(z) - (strpos(reverse(z), reverse(replace(s, '\n', chr(10)))) - 1) - length(replace(s, '\n', chr(10))) else -1 end) as p from h)
select doc_id, md5(case when length(text) <= 500 then text when p[1] > 300 then regexp_replace(substr(h, 1, p[1]), '\s+$', '') || chr(10) || '...'
  when p[2] > 300 then substr(h, 1, p[2] + 1) || ' ...' when p[3] > 300 then substr(h, 1, p[3] + 1) || ' ...' when p[4] > 300 then substr(h, 1, p[4] + 1) || ' ...'
  when p[5] > 300 then substr(h, 1, p[5] + 1) || ' ...' when p[6] > 300 then substr(h, 1, p[6]) || ' ...' else h || '...' end) as snippet_md5 from a""")
def snippet(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(tx.snippet("text")).alias("snippet_md5"))


HOSTILE = " <|im_start|> <<SYS>> [/INST] </system > <external_content a=1>\n  ## System : x"
_Z = "chr(8203)"


@query(rf"""with x as (select doc_id, text || ' <|im_start|> <<SYS>> [/INST] </system > <external_content a=1>' || chr(10) || '  ## System : x' as t from documents),
a as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(<)(\|[A-Za-z0-9_]{{1,32}}\|>)', '\1' || {_Z} || '\2', 'g'),
  '(<)(</?SYS>>)', '\1' || {_Z} || '\2', 'gi'), '(\[)(/?INST\])', '\1' || {_Z} || '\2', 'gi'),
  '(<)(/?(?:system|instructions?|assistant|user|human)\s*>)', '\1' || {_Z} || '\2', 'gi'), '(<)(/?external_content\b[^>]*>)', '\1' || {_Z} || '\2', 'gi') as t from x),
b as (select doc_id, regexp_replace(t, '(?im)^(?:([ \t])([ \t]{{0,2}}#{{1,6}}[ \t]*(?:system|instructions?|assistant|user|developer)[ \t]*:)|(#)(#{{0,5}}[ \t]*(?:system|instructions?|assistant|user|developer)[ \t]*:))', '\1\3' || {_Z} || '\2\4', 'g') as t from a)
select doc_id, md5(t) as text_md5, true as stable from b""")
def neutralize(spark, sf_dir):
    x = t(spark, sf_dir, "documents").select("doc_id", tx.neutralized(F.concat("text", F.lit(HOSTILE))).alias("t"))
    return x.select("doc_id", F.md5("t").alias("text_md5"), (tx.neutralized("t") == F.col("t")).alias("stable"))


@query("""select doc_id, 'x' || source || 'y' as source, sha256(text) as sha256,
  md5('<external_content source="x' || source || 'y" sha256="' || sha256(text) || '">' || chr(10) || text || chr(10) || '</external_content>') as fenced_md5 from documents""")
def provenance_fence(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", tx.fenced("text", F.concat(F.lit('x"<'), "source", F.lit(">'y"))).alias("f"))
    return d.select("doc_id", tx.marker("f").alias("m"), F.md5("f").alias("fenced_md5")).select("doc_id", "m.source", "m.sha256", "fenced_md5")


@query("select doc_id, substr(sha256(text), 1, 20) as content_hash, substr(sha256(source || ':' || lang || ':' || n_chars), 1, 16) as doc_key from documents")
def content_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.content_hash("text").alias("content_hash"), tx.document_key(F.col("source"), F.col("lang"), F.col("n_chars")).alias("doc_key"))


@query(r"""select page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug from pages""")
def url_slug(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", tx.slug("url").alias("slug"))


@query(f"""select doc_id, e = p or (not starts_with(e, '/') and not regexp_matches(e, '^[A-Za-z]:/') and ends_with(p, '/' || e)) as matches from (
  select doc_id, '/corpus/' || {PATH} as p, case doc_id % 4 when 0 then '/corpus/' || {PATH} when 1 then 'doc' || doc_id || '.md' when 2 then 'oc' || doc_id || '.md' else '/doc' || doc_id || '.md' end as e from documents)""")
def path_match(spark, sf_dir):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    full = F.concat(F.lit("/corpus/"), path())
    e = F.when(F.col("doc_id") % 4 == 0, F.replace(full, F.lit("/"), F.lit("\\"))).when(F.col("doc_id") % 4 == 1, name).when(F.col("doc_id") % 4 == 2, F.substring(name, 2, 99)).otherwise(F.concat(F.lit("/"), name))
    return t(spark, sf_dir, "documents").select("doc_id", tx.path_matches(e, full).alias("matches"))


@query(f"select doc_id, {PATH} as path from documents where not (regexp_matches({PATH}, '^src1.*7[.]md$') or lang = 'fr')")
def exclude_files(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", path().alias("path")).where(~tx.excluded("path", ("src1*7.md", "fr")))


# --- chunks ---

SPANS = r"""
recursive w(doc_id, text, n, s, e) as (
  select doc_id, text, length(text), 0, case when 1000 >= length(text) then length(text) else {cut0} end from documents where length(text) > 0
  union all
  select doc_id, text, n, ns, case when ns + 1000 >= n then n else {cut} end from (select *, case when e - 200 <= s then e else e - 200 end as ns from w) where ns < n)"""


def _cut(s: str) -> str:
    z = f"substring(text, {s} + 801, 200)"
    at = lambda sep, n: f"when strpos(reverse({z}), {sep}) > 0 then {s} + 800 + 200 - (strpos(reverse({z}), {sep}) - 1)"
    return "case " + " ".join([at("chr(10) || chr(10)", 2), at("chr(10)", 1), at("' .'", 2), at("' '", 1)]) + f" else {s} + 1000 end"


SPAN_SQL = SPANS.format(cut0=_cut("0"), cut=_cut("ns"))
CHUNK_SQL = rf"""{SPAN_SQL},
c0 as (select doc_id, s, e, regexp_replace(regexp_replace(substring(text, s + 1, e - s), '^\s+', ''), '\s+$', '') as content from w),
c as (select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as chunk_index, s::int as start_char, e::int as end_char, content from c0 where content <> '')"""


def doc_chunks(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return ch.chunks(d).withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"with {CHUNK_SQL} select doc_id, chunk_index, start_char, end_char, md5(content) as content_md5, doc_id || '_' || chunk_index as chunk_id from c")
def chunk_text(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("doc_id", "chunk_index", "start_char", "end_char", F.md5("content").alias("content_md5"), "chunk_id")


@query(f"with {CHUNK_SQL} select doc_id, min(chunk_index)::int as chunk_index, substr(sha256(content), 1, 20) as content_hash from c group by doc_id, content")
def dedup_chunks(spark, sf_dir):
    return ch.deduplicated(doc_chunks(spark, sf_dir)).select("doc_id", "chunk_index", "content_hash")


@query()
def chunk_markdown(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\n", "\n## ").alias("content"))
    return ch.chunks(d, markdown="true")


@query(f"""with {CHUNK_SQL}, h as (select doc_id, max(chunk_index) // 2 as chunk_index from c group by doc_id)
select h.doc_id, h.chunk_index::int as chunk_index, (b.content is not null or a.content is not null) as context_expanded,
  md5(concat_ws(chr(10) || chr(10), b.content, m.content, a.content)) as content_md5
from h join c m using (doc_id, chunk_index) left join c b on b.doc_id = h.doc_id and b.chunk_index = h.chunk_index - 1 left join c a on a.doc_id = h.doc_id and a.chunk_index = h.chunk_index + 1""")
def neighbor_expand(spark, sf_dir):
    c = doc_chunks(spark, sf_dir)
    mid = c.groupBy("doc_id").agg(F.expr("max(chunk_index) div 2").cast("int").alias("chunk_index"))
    x = rt.expanded(mid.join(c, ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "content"), c)
    return x.select("doc_id", "chunk_index", "context_expanded", F.md5("content").alias("content_md5"))


# --- index and retrieval ---


@query(f"with {INDEX} select doc_id, term, tf, dl::int as dl from post")
def postings(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    if d.groupBy("doc_id").count().where("count > 1").isEmpty():  # each document's words are counted where it lies
        return blockmax.postings(blockmax.blocks(ix.tokenized(corpus(spark, sf_dir), "doc_id"), "doc_id"), "doc_id")
    return doc_index(spark, sf_dir)["postings"].select("doc_id", "term", "tf", "dl")


@query(f"with {INDEX} select term, df, round(idf, 6) as idf from idf")
def term_stats(spark, sf_dir):
    return doc_index(spark, sf_dir)["term_stats"].select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {INDEX} select n, round(avgdl, 6) as avgdl from st")
def corpus_stats(spark, sf_dir):
    return doc_index(spark, sf_dir)["corpus_stats"].select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"with {BM} select query_id, rank, doc_id, round(score, 6) as score from {top('bm_all', 'round(score, 9) desc, doc_id', 10)}")
def bm25_topk(spark, sf_dir):
    return best(spark, sf_dir, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"""with {BM}, f as (select bm_all.* from bm_all join documents using (doc_id) where {CAT} = 'beta')
select query_id, rank, doc_id, round(score, 6) as score from {top('f', 'round(score, 9) desc, doc_id', 10)}""")
def category_filtered_search(spark, sf_dir):
    d = corpus(spark, sf_dir)
    parts = [blockmax.blocks(ix.tokenized(d.where(which), "doc_id"), "doc_id").withColumn("kept", F.lit(kept)) for which, kept in (("category = 'beta'", True), ("category <> 'beta'", False))]
    index = written(parts[0].union(parts[1]), "blocks")
    found = blockmax.searched(log(spark, sf_dir), index.where("kept").drop("kept"), 10, "doc_id", stats=blockmax.statistics(index))
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"with {KNN} select query_id, rank, doc_id, round(distance, 6) as distance from {top('knn_all', 'round(distance, 9), doc_id', 10)}")
def knn_topk(spark, sf_dir):
    return rt.nearest(probes(spark, sf_dir), doc_vectors(spark, sf_dir), 10, "doc_id").select("query_id", "rank", "doc_id", F.round("distance", 6).alias("distance"))


@query()
def ann_topk(spark, sf_dir):
    """The same from inverted lists of codes, at a recall of 0.9 or more (ann_recall measures it)."""
    v = doc_vectors(spark, sf_dir).select("doc_id", "embedding")
    return ann.searched(probes(spark, sf_dir), ann.indexed(v, "doc_id"), 10).select("query_id", "rank", "doc_id", F.round("distance", 6).alias("distance"))


@query("select count(*) as n_queries, true as reached from (select vec_id from embeddings where vec_id in (select item_id from benchmark) or vec_id % 50 = 0)")
def ann_recall(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.join(rt.small(t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), F.lit(1).alias("asked"))), "vec_id", "left").where("asked = 1 or vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    found = ann.searched(q, ann.indexed(v, "vec_id"), 10)
    return ann.recall(found, rt.nearest(q, v, 10, "vec_id"), "vec_id").select(F.col("n").alias("n_queries"), (F.col("recall") >= 0.9).alias("reached"))


@query(f"""with v as (select vec_id as doc_id, embedding, source from embeddings join documents on vec_id = doc_id),
x as (select b.doc_id as query_id, a.doc_id as doc_id, a.source as source, {L2} as distance from v a, v b where b.doc_id % 20 = 0),
n as {top('x', 'round(distance, 9), doc_id::varchar', 25, 'raw_rank')},
o as (select *, row_number() over (partition by query_id, source order by raw_rank) as one from n where doc_id <> query_id)
select query_id, rank, doc_id::varchar as chunk_id, source, round(greatest(0.0, 1 - distance), 4) as similarity from {top('(select * from o where one = 1)', 'raw_rank', 5)}""")
def search_similar(spark, sf_dir):
    v = doc_vectors(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("chunk_id", F.col("doc_id").cast("string")).withColumn("chunk_index", F.lit(0))
    return rt.similar(v.where("doc_id % 20 = 0").select("doc_id"), v)


@query(f"with {FUSED} select query_id, doc_id, coalesce(semantic_rank, 1000) as semantic_rank, coalesce(bm25_rank, 1000) as bm25_rank, round(rrf_score, 9)::double as rrf_score from rrf")
def rrf_fuse(spark, sf_dir):
    s = rt.nearest(probes(spark, sf_dir), doc_vectors(spark, sf_dir), 30, "doc_id")
    b = best(spark, sf_dir, 30)
    return rt.fused(s, b, 0.5, "doc_id").withColumn("rrf_score", F.round("rrf_score", 9)).fillna(rt.MISSING, ["semantic_rank", "bm25_rank"])


HYBRID = f"""{FUSED},
d as (select doc_id, text, {PATH} as path, {CAT} as category from documents),
j as (select rrf.*, item.text as q, d.text as content, d.path as path, d.category as category, lower(d.path || ' doc' || rrf.doc_id || '.md') as pl from rrf join d using (doc_id) join benchmark item on item.item_id = rrf.query_id),
w as (select *, regexp_extract_all(lower(q), '{WORDS}') as qt, regexp_extract_all(pl, '{WORDS}') as pt from j),
o as (select *, rrf_score + least(0.003, coalesce(list_sum(list_transform(qt, lambda x: case when list_contains(pt, x) then 0.0006 when contains(pl, x) then 0.0003 else 0 end)), 0)
  + case when contains(pl, lower(trim(q))) then 0.0012 else 0 end) as boosted from w),
k as {top('o', 'round(boosted, 12) desc, doc_id', 10)},
f as (select *, min(boosted) over (partition by query_id) as lo, max(boosted) over (partition by query_id) as hi from k)"""


@query(f"""with {HYBRID} select query_id, rank, doc_id, round(case when hi > lo then (boosted - lo) / (hi - lo) else 1 end, 4)::double as score, round(rrf_score, 6)::double as raw_rrf_score, coalesce(semantic_rank, 1000) as semantic_rank, coalesce(bm25_rank, 1000) as bm25_rank,
  case when semantic_rank is not null and bm25_rank is not null then 'hybrid' when semantic_rank is not null then 'semantic' else 'keyword' end as search_method, category from f""")
def hybrid_search(spark, sf_dir):
    engine = HybridSearch(corpus(spark, sf_dir), doc_vectors(spark, sf_dir), "doc_id", {"blocks": doc_blocks(spark, sf_dir)})
    r = engine.run(log(spark, sf_dir), probes(spark, sf_dir), k=10, pool=30, alpha=0.5)
    return r.select("query_id", "rank", "doc_id", "score", "raw_rrf_score", "semantic_rank", "bm25_rank", "search_method", "category").fillna(rt.MISSING, ["semantic_rank", "bm25_rank"])


@query(f"""with {HYBRID} select query_id, count(*) as n, count(*) filter (where case when hi > lo then round((boosted - lo) / (hi - lo), 4) else 1 end < 0.5) as n_filtered from f group by query_id""")
def min_score_filter(spark, sf_dir):
    r = hybrid_search(spark, sf_dir)
    return r.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 0.5).alias("n_filtered"))


@query(f"""with {BM}, k as {top('bm_all', 'round(score, 9) desc, doc_id', 8)}
select query_id, doc_id, case when max(score) over w > min(score) over w then round((score - min(score) over w) / (max(score) over w - min(score) over w), 4) else 1 end as relative from k window w as (partition by query_id)""")
def score_normalize(spark, sf_dir):
    r = best(spark, sf_dir, 8)
    return r.select("query_id", "doc_id", rt.cohort_score(r, "score").alias("relative"))


@query(f"""with {BM}, k as {top('bm_all', 'round(score, 9) desc, doc_id', 20)},
x as (select k.query_id, k.doc_id, k.rank as old_rank, list_distinct({dtok('b.text')}) as qt, {dtok('d.text')} as dt from k join benchmark b on b.item_id = k.query_id join documents d using (doc_id)),
y as (select query_id, doc_id, old_rank, case when len(qt) > 0 then len(list_intersect(qt, dt)) / len(qt) else 0 end::double as s from x)
select query_id, rank, doc_id, old_rank, round(s, 6) as reranker_score from {top('y', 'round(s, 9) desc, old_rank', 5)}""")
def rerank_lexical(spark, sf_dir):
    q = log(spark, sf_dir)
    h = rt.small_pool(best(spark, sf_dir, 20).join(q, "query_id"), q, 20).join(corpus(spark, sf_dir).select("doc_id", "content"), "doc_id")
    return rt.reranked(h, 5).select("query_id", "rank", "doc_id", "old_rank", F.round("reranker_score", 6).alias("reranker_score"))


@query(rf"""with recursive {BM}, k as materialized {top('bm_all', 'round(score, 9) desc, doc_id', 30)},
x as materialized (select k.*, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) as words, max(score) over w as hi, min(score) over w as lo, count(*) over w as n from k join documents using (doc_id) window w as (partition by query_id)),
sims as materialized (select a.query_id, a.rank, list(case when len(a.words) = 0 or len(b.words) = 0 then 0 else len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) end order by b.rank) as sim from x a join x b using (query_id) group by all),
y as materialized (select query_id, rank, n, case when hi > lo then (score - lo) / (hi - lo) else 1 end as relevance, sim from x join sims using (query_id, rank)),
pick(query_id, n, taken) as (
  select query_id, n, [rank::bigint] from y where rank = 1
  union all
  select query_id, any_value(n), list_append(any_value(taken), arg_max(rank, [round(case when n <= 10 then 0 else 0.7 * relevance - 0.3 * list_max(list_transform(taken, lambda i: sim[i])) end, 12), -rank])::bigint)
  from (select y.*, taken from pick join y using (query_id) where len(taken) < 10 and not list_contains(taken, rank)) group by query_id)
select query_id, doc_id, rank, list_position(taken, rank)::int as mmr_rank from (select query_id, arg_max(taken, len(taken)) as taken from pick group by all) join k using (query_id) where list_contains(taken, rank)""")
def mmr_select(spark, sf_dir):
    h = best(spark, sf_dir, 30).join(corpus(spark, sf_dir).select("doc_id", "content"), "doc_id").withColumn("relevance", F.col("score"))
    return rt.diversified(h, 10, key="doc_id").select("query_id", "doc_id", "rank", "mmr_rank")


def _lex(c: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}._-]+')"


#: A query's blank-separated parts are phrases: their words have to stand side by side.
FTS = f"""c as materialized (select doc_id, t, len(t) as dl from (select doc_id, {_lex("text || ' doc' || doc_id || '.md ' || (" + CAT + ")")} as t from documents)),
q as (select query_id, {_lex("part")} as p from (select item_id as query_id, unnest(string_split_regex(text, '\\s+')) as part from benchmark)),
each as materialized (select query_id, p, count(*) as times from q where len(p) > 0 group by all),
asked as materialized (select distinct p, p[1] as term from each),
ex as (select doc_id, unnest(t) as term, unnest(range(1, len(t) + 1)) as i from c),
tf as materialized (select p, doc_id, max(dl) as dl, count(*) as tf from asked join ex using (term) join c using (doc_id) where len(p) = 1 or t[i:i + len(p) - 1] = p group by all),
df as (select p, count(*) as df from tf group by all),
s as (select count(*) as n, avg(dl) as avgdl from c),
need as (select query_id, count(*) as need from each group by all),
hits as (select query_id, doc_id, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) as score, count(*) as held from each join tf using (p) join df using (p), s group by all),
fts as (select query_id, doc_id, score from hits join need using (query_id) where held = need)"""


def fts_hits(spark, sf_dir) -> DataFrame:
    return rt.phrase_hits(log(spark, sf_dir), corpus(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id")).withColumnRenamed("chunk_id", "doc_id")


@query(f"with {FTS} select query_id, rank, doc_id, round(score, 6) as score from {top('fts', 'round(score, 9) desc, doc_id', 20)}")
def fts_search(spark, sf_dir):
    return rt.ranked(fts_hits(spark, sf_dir), [F.desc(F.round("score", 9)), F.asc("doc_id")], 20).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"with {FTS} select query_id, rank, doc_id, round(score, 6) as score from {top('fts', 'round(score, 9) desc, doc_id', 20)}")
def fts_index_search(spark, sf_dir):
    index = lx.entries(corpus(spark, sf_dir), "doc_id")  # read once; a server holds it written
    hits = lx.phrase_hits(log(spark, sf_dir), index, "doc_id")
    return rt.ranked(hits, [F.desc(F.round("score", 9)), F.asc("doc_id")], 20).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


EDITED = "from (select * replace (case when doc_id % 7 = 0 then text || ' and some words more' else text end as text) from documents where doc_id % 5 <> 0)"


@query(f"with {FTS.replace('from documents', EDITED, 1)} select query_id, doc_id, round(score, 6) as score from fts")
def fts_index_edits(spark, sf_dir):
    d = corpus(spark, sf_dir)
    index = lx.inserted(lx.entries(d.where("doc_id % 3 <> 0"), "doc_id"), d.where("doc_id % 3 = 0"), "doc_id")
    index = lx.replaced(index, d.where("doc_id % 7 = 0").withColumn("content", F.concat("content", F.lit(" and some words more"))), "doc_id")
    index = lx.deleted(index, d.where("doc_id % 5 = 0"), "doc_id")  # asked for once; the choice of entries goes below the deletions
    hits = lx.phrase_hits(log(spark, sf_dir), index, "doc_id")
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""with {FTS}, h as (select query_id, count(*) as hits from fts group by all),
x as (select item_id as query_id, text, case item_id % 3 when 0 then 'auto' when 1 then 'fts5' else 'hybrid' end as method from benchmark)
select query_id, method, coalesce(hits, 0) as hits, case when method = 'auto' and regexp_matches(text, '[A-Z]{{2,}}-\\d+') and coalesce(hits, 0) >= 3 or method = 'fts5' and coalesce(hits, 0) > 0 then 'lexical' else 'hybrid' end as route
from x left join h using (query_id)""")
def auto_dispatch(spark, sf_dir):
    q = log(spark, sf_dir).withColumn("method", F.when(F.col("query_id") % 3 == 0, "auto").when(F.col("query_id") % 3 == 1, "fts5").otherwise("hybrid"))
    return rt.dispatched(q, fts_hits(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("hits")))


@query(f"""with {BM}, k as {top('bm_all', 'round(score, 9) desc, doc_id', 5)},
c as (select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text)),
h as (select query_id, min(rank) as hit from c join k using (query_id, doc_id) group by all),
a as (select distinct query_id from c)
select count(*) as n, round(avg(coalesce(1.0 / hit, 0)), 4)::double as mrr, round(avg((hit is not null)::int), 4) as recall from a left join h using (query_id)""")
def evaluate_mrr(spark, sf_dir):
    d = corpus(spark, sf_dir)
    q = log(spark, sf_dir)
    cases = rt.holding(q, d.select("content", F.col("path").alias("expected"))).select("query_id", "expected")
    r = best(spark, sf_dir, 5).join(d.select("doc_id", F.col("path").alias("source")), "doc_id")
    return rt.evaluated(cases, rt.small_pool(r, q, 5))


# --- evidence ---

UNITS = rf"""{BM}, k as {top('bm_all', 'round(score, 9) desc, doc_id', 5)},
b as (select query_id, rank, item.text as q, unnest(string_split_regex(d.text, '\n\s*\n')) as block, unnest(range(len(string_split_regex(d.text, '\n\s*\n')))) as position from k join documents d using (doc_id) join benchmark item on item.item_id = query_id),
l as (select query_id, rank, position::int as position, q, regexp_replace(array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' and not regexp_matches(x, '^(?:#|\||```|~~~)') and not regexp_matches(x, '^[|\s:+=_-]+$')),
  lambda x: trim(regexp_replace(x, '^(?:[-*•>–—]|\d+[.)])\s+', ''))), lambda x: x <> ''), ' '), '\s+', ' ', 'g') as t from b),
u0 as (select *, case when length(t) > 500 then regexp_replace(substr(t, 1, 500), '\s+$', '') || '…' else t end as unit_text from l where length(t) >= 30),
u1 as (select *, row_number() over (partition by query_id, lower(unit_text) order by rank, position) as again from u0),
s0 as (select item_id as query_id, list_transform(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 and x not in ('the', 'and')), lambda x: x[1:6]) as s from benchmark),
s1 as (select query_id, list_filter(s, lambda x, i: list_position(s, x) = i) as stems from s0),
u2 as (select u1.*, len(list_filter(stems, lambda x: contains(lower(unit_text), x))) as "distinct", coalesce(list_sum(list_transform(stems, lambda x: length(x) * ((length(unit_text) - length(replace(lower(unit_text), x, ''))) // length(x)))), 0) as weighted from u1 join s1 using (query_id) where again = 1),
u3 as (select *, max("distinct") over (partition by query_id) as best from u2),
u4 as (select *, row_number() over w as n, sum(length(unit_text)) over w as total from u3 where 2 * "distinct" > best window w as (partition by query_id order by "distinct" desc, weighted desc, rank, position)),
u as (select query_id, 'E' || row_number() over (partition by query_id order by rank, position) as uid, rank, position, "distinct", weighted, unit_text from u4 where n <= 12 and total <= 16000)"""


def _units(spark, sf_dir) -> DataFrame:
    q = log(spark, sf_dir)
    r = rt.small_pool(best(spark, sf_dir, 5).join(q, "query_id"), q, 5).join(corpus(spark, sf_dir).select("doc_id", "content"), "doc_id")
    return ev.units(r.select("query_id", "query_text", "rank", "content"), STOP)


@query(f"""with {UNITS} select query_id, uid, rank, position, "distinct"::int as "distinct", weighted::int as weighted, md5(unit_text) as unit_md5 from u""")
def evidence_units(spark, sf_dir):
    return _units(spark, sf_dir).select("query_id", "uid", "rank", "position", "distinct", "weighted", F.md5("unit_text").alias("unit_md5"))


@query(f"""with {UNITS}, f as {top('u', '"distinct" desc, weighted desc, rank, position', 5, 'm')}
select query_id, md5('Sources:' || chr(10) || string_agg('— ' || unit_text || ' [' || rank || ']', chr(10) order by rank, position)) as answer_md5 from f group by query_id""")
def fallback_answer(spark, sf_dir):
    f = ev.fallback(_units(spark, sf_dir))
    f = f.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "position")))
    return ev.composed(f, "Sources:").select("query_id", F.md5("answer").alias("answer_md5"))


# --- maintenance ---


def _files(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(path().alias("source"), F.col("doc_id"), F.col("n_chars").alias("size"), (F.col("doc_id") * 10).alias("mtime"))
    now = d.where("doc_id % 11 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return now, d.where("doc_id % 5 <> 0")


CHANGES = f"""f as (select {PATH} as source, n_chars as size, doc_id * 10 + case when doc_id % 7 = 0 then 1 else 0 end as mtime, doc_id from documents where doc_id % 11 <> 0),
i as (select {PATH} as source, n_chars as size, doc_id * 10 as mtime, doc_id from documents where doc_id % 5 <> 0),
ch as (select source, case when f.source is null then 'deleted' when i.source is null then 'new' when f.mtime = i.mtime and f.size = i.size then 'unchanged' else 'updated' end as change from f full join i using (source))"""


@query(f"with {CHANGES} select * from ch")
def classify_changes(spark, sf_dir):
    return mt.classified(*_files(spark, sf_dir))


@query(f"with {CHANGES} select count(*) as total, count(*) filter (where change = 'new') as added, count(*) filter (where change = 'updated') as updated, count(*) filter (where change = 'unchanged') as skipped, count(*) filter (where change = 'deleted') as deleted from ch")
def indexing_stats(spark, sf_dir):
    return mt.indexing_stats(mt.classified(*_files(spark, sf_dir)))


REPORT = f"""{CHANGES},
made as (select {PATH} as source, doc_id, {CAT} as category, n_chars // 800 + 1 as chunks, n_chars % 3 as repeats from documents),
files as (select *, change in ('new', 'updated') and doc_id % 23 <> 1 as done from ch join made using (source))"""


@query(f"""with {REPORT} select count(*) filter (where change <> 'deleted') as total_files, count(*) filter (where done and change = 'new') as indexed, count(*) filter (where done and change = 'updated') as updated,
  count(*) filter (where change = 'unchanged') as skipped, count(*) filter (where change = 'deleted') as deleted, count(*) filter (where change in ('new', 'updated') and doc_id % 23 = 1) as errors,
  coalesce(sum(chunks) filter (where done), 0)::bigint as chunks_added, coalesce(sum(chunks) filter (where done and change = 'updated' or change = 'deleted'), 0)::bigint as chunks_removed,
  coalesce(sum(repeats) filter (where done), 0)::bigint as dedup_skipped, (select string_agg(category || '=' || n, ',' order by category) from (select category, count(*) as n from files where done group by category)) as categories from files""")
def indexing_report(spark, sf_dir):
    made = corpus(spark, sf_dir, "n_chars").select(F.col("path").alias("source"), "doc_id", "category", F.floor(F.col("n_chars") / 800).alias("whole"), (F.col("n_chars") % 3).alias("repeats"))
    f = mt.classified(*_files(spark, sf_dir)).join(made, "source").withColumn("chunks", F.col("whole") + 1).withColumn("old_chunks", F.col("chunks"))
    f = f.withColumn("error", F.when(F.col("change").isin("new", "updated") & (F.col("doc_id") % 23 == 1), "unreadable"))
    return mt.indexing_report(f).withColumn("categories", F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("""with s as (select source, doc_id as t, row_number() over (partition by source order by doc_id) as n, n_chars // 800 + 1 as chunks, count(*) over (partition by source) as total from documents),
p as (select *, (sum(chunks) over (partition by source order by n))::bigint as processed from s),
w as (select *, greatest(processed, floor(processed::double / n * total)::bigint) as estimate, t - greatest(min(t) over r, first_value(t) over l) as seconds, processed - greatest(min(processed) over r, first_value(processed) over l) as done
  from p window r as (partition by source order by t range between 30 preceding and current row), l as (partition by source order by n rows between 99 preceding and current row)),
x as (select *, case when seconds > 0 then done::double / seconds else 0.0::double end as throughput from w)
select source, n, processed, estimate, throughput, case when throughput > 0 and estimate > processed then floor((estimate - processed) / throughput)::bigint else 0 end as eta from x""")
def reindex_progress(spark, sf_dir):
    run = Window.partitionBy("source")
    d = t(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("t"), F.row_number().over(run.orderBy("doc_id")).alias("n"), (F.floor(F.col("n_chars") / 800) + 1).alias("chunks"), F.count("*").over(run).alias("total"))
    return mt.progress(d, "source")


@query(f"""select source, count(*) as files, sum(('0x' || substr(sha256({PATH} || chr(0) || sha256(text) || chr(0) || octet_length(encode(text)) || chr(10)), 1, 12))::bigint)::varchar as digest_sum from documents group by source""")
def tree_digest(spark, sf_dir):
    d = corpus(spark, sf_dir, "source").select("source", "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size"))
    return mt.tree_digest(d, "source")


@query("""with f as (select doc_id, source || case doc_id % 6 when 0 then '/.git/doc' when 1 then '/drafts/doc' else '/doc' end || doc_id || case doc_id % 5 when 0 then '/.DS_Store' when 1 then '.MD' when 2 then '.bin' else '.md' end as path from documents)
select doc_id, path from f where doc_id % 6 > 1 and doc_id % 5 not in (0, 2)""")
def corpus_admission(spark, sf_dir):
    n, suffix = F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("/.DS_Store", ".MD", ".bin", ".md", ".md")]), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 6 == 0, "/.git/doc").when(F.col("doc_id") % 6 == 1, "/drafts/doc").otherwise("/doc")
    listing = t(spark, sf_dir, "documents").select("doc_id", F.concat("source", folder, n, suffix).alias("path"), F.lit("file").alias("kind"))
    return mt.admitted(listing, (".md", ".txt"), ("drafts",)).select("doc_id", "path")


@query("select doc_id, lang, n_chars from documents where doc_id > 57 order by doc_id limit 40")
def keyset_page(spark, sf_dir):
    return mt.page(t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 57, 40)


@query(f"with {CHANGES} select source from i where source not in (select source from f)")
def orphans(spark, sf_dir):
    now, old = _files(spark, sf_dir)
    return mt.orphans(old, now).select("source")


@query(f"with {CHANGES} select doc_id, source from f where doc_id % 3 <> 1")
def resume_anti(spark, sf_dir):
    now, _ = _files(spark, sf_dir)
    return mt.remaining(now, t(spark, sf_dir, "documents").where("doc_id % 3 = 1").select("doc_id")).select("doc_id", "source")


@query("""select doc_id, md5(text || case when doc_id % 7 = 0 then ' changed' else '' end) as text_md5, doc_id % 7 = 0 as fresh from documents where doc_id % 7 = 0 or doc_id % 11 <> 0""")
def merge_documents(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text", F.lit(False).alias("fresh"))
    fresh = d.where("doc_id % 7 = 0").select("doc_id", F.concat("text", F.lit(" changed")).alias("text"), F.lit(True).alias("fresh"))
    return mt.merged(d, fresh, d.where("doc_id % 11 = 0"), "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "fresh")


def _manifests(spark, sf_dir):
    d = corpus(spark, sf_dir)
    a = mt.manifest(d.where("doc_id % 13 <> 0"), "path", "content")
    return a, mt.manifest(d.where("doc_id % 17 <> 0").withColumn("content", F.when(F.col("doc_id") % 19 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))), "path", "content")


MANIFESTS = f"""a as (select {PATH} as path, sha256(text) as s from documents where doc_id % 13 <> 0),
b as (select {PATH} as path, sha256(text || case when doc_id % 19 = 0 then '!' else '' end) as s from documents where doc_id % 17 <> 0)"""


@query(f"with {MANIFESTS} select path, case when b.s is null then 'missing' when a.s is null then 'extra' else 'differing' end as difference from a full join b using (path) where a.s is distinct from b.s")
def manifest_diff(spark, sf_dir):
    return mt.manifest_diff(*_manifests(spark, sf_dir))


@query(f"with {MANIFESTS} select (select count(*) from a) as left_rows, (select count(*) from b) as right_rows, (select count(*) from (from a except all from b)) as left_only, (select count(*) from (from b except all from a)) as right_only")
def backend_parity(spark, sf_dir):
    return mt.parity(*_manifests(spark, sf_dir), "path")


@query(f"with {MANIFESTS} select path, case when b.s is null then 'missing' when a.s is null then 'extra' else 'differing' end as difference from a full join b using (path) where a.s is distinct from b.s")
def tree_diff(spark, sf_dir):
    return dg.differing_rows(*_manifests(spark, sf_dir), "path", "sha256")


@query("""with f as (select sha256(doc_id::varchar) as p, octet_length(encode(doc_id::varchar)) || ':' || doc_id || ';' || coalesce(octet_length(encode(text)) || ':' || text || ';', '-;') || coalesce(octet_length(encode(source)) || ':' || source || ';', '-;') as row from documents),
h as (select level, substr(p, 1, 2 * level) as prefix, sha256(row) as h from f, (values (0), (1)) l(level)),
s as (select level, prefix, count(*) as n, sum(('0x' || substr(h, 1, 12))::bigint) as s0, sum(('0x' || substr(h, 13, 12))::bigint) as s1, sum(('0x' || substr(h, 25, 12))::bigint) as s2, sum(('0x' || substr(h, 37, 12))::bigint) as s3 from h group by all)
select level, prefix, n, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) as digest from s""")
def digest_tree(spark, sf_dir):
    return dg.tree(t(spark, sf_dir, "documents"), "doc_id", "text", "source", depth=1).select("level", "prefix", "n", "digest")


@query("""with h as (select sha256(octet_length(encode(doc_id::varchar)) || ':' || doc_id || ';' || octet_length(encode(text)) || ':' || text || ';' || octet_length(encode(lang)) || ':' || lang || ';') as h from documents)
select count(*) as n, sum(('0x' || substr(h, 1, 12))::bigint)::varchar as digest_sum from h""")
def row_digest(spark, sf_dir):
    return mt.set_digest(t(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query(f"with {BM}, h as (select query_id, count(*) as hits from bm_all where query_id < 5 group by all), x as (select (select count(*) from documents) as n_rows, (select count(*) from h where hits > 0) as n_hits) select n_rows, n_hits, n_rows >= 0.9 * 100 as enough_rows, n_hits >= 4 as enough_hits, n_rows >= 0.9 * 100 and n_hits >= 4 as passed from x")
def staging_gates(spark, sf_dir):
    q = log(spark, sf_dir).where("query_id < 5")  # the sanity queries
    hits = blockmax.matched(q, doc_blocks(spark, sf_dir))
    return mt.gates(t(spark, sf_dir, "documents"), 100, hits)


@query(f"select category, count(*) as n from (select {CAT} as category from documents) group by rollup (category)")
def category_counts(spark, sf_dir):
    return mt.category_counts(corpus(spark, sf_dir))


@query(f"select doc_id, {PATH} as source, 'doc' || doc_id || '.md' as filename from documents where {CAT} = 'gamma'")
def list_documents(spark, sf_dir):
    return corpus(spark, sf_dir).where("category = 'gamma'").select("doc_id", F.col("path").alias("source"), "filename")


@query(f"""with {CHUNK_SQL} select (select count(*) from documents) as total_documents, (select count(*) from c) as total_chunks, (select count(distinct {CAT}) from documents) as categories,
  round((select count(*) from c) / (select count(*) from documents), 4) as chunks_per_document, (select max(len(embedding)) from embeddings)::int as embedding_dim""")
def index_stats(spark, sf_dir):
    d, c = corpus(spark, sf_dir), doc_chunks(spark, sf_dir)
    one = d.agg(F.count("*").alias("total_documents"), F.countDistinct("category").alias("categories")).crossJoin(c.agg(F.count("*").alias("total_chunks")))  # one row each
    one = one.crossJoin(t(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("embedding_dim")))
    return one.withColumn("chunks_per_document", F.round(F.col("total_chunks") / F.col("total_documents"), 4))


@query("select count(*) as n, count(distinct doc_id) as n_keys, count(*) = count(distinct doc_id) as \"unique\" from documents")
def keys_consistent(spark, sf_dir):
    return mt.keys_consistent(t(spark, sf_dir, "documents"), "doc_id")


@query("select count(*) as n, count(*) filter (where len(embedding) <> 64) as wrong from embeddings")
def dimension_check(spark, sf_dir):
    return mt.dimension_mismatch(t(spark, sf_dir, "embeddings"), 64)


@query(f"""with f as (select {PATH} as path, sha256(text) as s from documents), n(namespace) as (values ('src1'), ('src2'), ('src3/en'))
select namespace, count(*) as n, sum(('0x' || substr(sha256(path || ':' || s), 1, 12))::bigint)::varchar as digest_sum from f join n on path = namespace or starts_with(path, namespace || '/') group by namespace""")
def namespace_digests(spark, sf_dir):
    return mt.namespaces(mt.manifest(corpus(spark, sf_dir), "path", "content"), spark.createDataFrame([("src1",), ("src2",), ("src3/en",)], "namespace string"))


@query("""with m as (select event_type, case when event_id % 2 = 0 then 0 else 1 end as side, median(value) as m from events group by all),
x as (select a.event_type as name, a.m as was, b.m as now from m a join m b on a.event_type = b.event_type and a.side = 0 and b.side = 1)
select name, round((now - was) / was, 6) as delta, (now - was) / was > 0.1 and greatest(now, was) >= 0.001 as regressed from x""")
def perf_regressions(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), (F.col("event_id") % 2).alias("side")).agg(F.median("value").alias("median"))
    return mt.regressions(e.where("side = 0"), e.where("side = 1"))


@query("""select doc_id as record_id, md5('---' || chr(10) || 'lang: "' || lang || '"' || chr(10) || 'source: "' || source || '"' || chr(10) || '---' || chr(10) || text) as markdown_md5 from documents where length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) > 80""")
def snapshot_markdown(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumnRenamed("doc_id", "record_id")
    return sn.rendered(d, ["lang", "source"], "text").select("record_id", F.md5("markdown").alias("markdown_md5"))


@query("""select doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","nested":{"a":[' || n_chars || ',null,true],"b":"' || source || '"}}' as metadata from documents""")
def canonical_metadata(spark, sf_dir):
    nested = F.struct(F.col("source").alias("b"), F.array(F.col("n_chars").cast("string"), F.lit("null"), F.lit("true")).alias("a"))
    raw = F.regexp_replace(F.to_json(F.struct("lang", nested.alias("nested"), "doc_id")), r'"(\d+|null|true)"', "$1")
    return t(spark, sf_dir, "documents").select("doc_id", cn.canonical_json(raw).alias("metadata"))


@query("""with x as (select vec_id, n, embedding[n]::double as v from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as n from embeddings)),
e0 as (select *, case when v = 0 then 0 else floor(log2(abs(v)))::int end as e from x),
e1 as (select *, case when v = 0 then 0 when abs(v) < 2.0 ** e then e - 1 when abs(v) >= 2.0 ** (e + 1) then e + 1 else e end as f from e0),
b as (select *, case when v = 0 then 0::hugeint else (f + 1023)::hugeint * 4503599627370496 + ((abs(v) / 2.0 ** f - 1) * 4503599627370496)::hugeint + case when v < 0 then 9223372036854775808::hugeint else 0 end end as bits from e1)
select vec_id, sha256(string_agg(lpad(lower(to_hex(bits::ubigint)), 16, '0'), '' order by n)) as packed_sha256 from b group by vec_id""")
def packed_vectors(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", F.sha2(F.lower(F.hex(cn.packed("embedding"))), 256).alias("packed_sha256"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else '.' || lpad((epoch_us(ts) % 1000000)::varchar, 6, '0') end as iso from events""")
def iso_times(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", cn.iso("ts").alias("iso"))


@query("select event_id, (json_extract(props, '$.k'))::bigint as k from events")
def json_properties(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query()
def html_to_text(spark, sf_dir):
    return ps.pages(t(spark, sf_dir, "pages"))


@query()
def parse_files(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    kind = F.element_at(F.array(F.lit(".md"), F.lit(".txt"), F.lit(".json"), F.lit(".csv"), F.lit(".py"), F.lit(".xml")), (F.col("doc_id") % 6 + 1).cast("int"))
    files = d.select(F.concat(F.lit("/corpus/doc"), F.col("doc_id").cast("string"), kind).alias("path"), F.encode("text", "UTF-8").alias("content"), F.timestamp_seconds(F.col("doc_id")).alias("modificationTime"), F.col("n_chars").alias("length"))
    return ps.parsed(files).select("doc_id", "source", "format", F.md5("content").alias("content_md5"), "meta.type", "meta.line_count", "meta.is_valid_json", "meta.rows", "error")


# --- logs and streams ---


@query("""with x as (select event_type, event_id, epoch_us(ts) / 1e6 as t from events),
y as (select event_type, event_id, t, min(t) over r as m, count(*) over r as n, first_value(t) over l as f from x window r as (partition by event_type order by t range between 3600 preceding and current row), l as (partition by event_type order by t, event_id rows between 99 preceding and current row))
select event_type, event_id, least(n, 100) as samples, round(t - greatest(m, f), 6) as span_s from y""")
def throughput_window(spark, sf_dir):
    return es.throughput(t(spark, sf_dir, "events"), "event_type", 3600)


@query("""with b(le, x) as (values ('0.5', 0.5), ('1.0', 1.0), ('5.0', 5.0), ('10.0', 10.0), ('50.0', 50.0), ('100.0', 100.0), ('+Inf', 1e308)),
s as (select event_type, count(value) as c, round(sum(value), 2) as s from events group by all)
select event_type, le, count(*) filter (where value <= x) as cumulative, any_value(c) as _count, any_value(s) as _sum from events, b join s using (event_type) group by event_type, le""".replace("from events, b join s using (event_type)", "from (select e.event_type, e.value, b.le, b.x, s.c, s.s from events e cross join b join s on s.event_type = e.event_type)"))
def latency_histogram(spark, sf_dir):
    return es.histogram(t(spark, sf_dir, "events"), "value", [0.5, 1.0, 5.0, 10.0, 50.0, 100.0], "event_type").withColumn("_sum", F.round("_sum", 2))


@query("select n, least(10 * 2.0 ** n, 300)::double as delay from (select unnest(range(10)) as n)")
def backoff_schedule(spark, sf_dir):
    return spark.range(10).select(F.col("id").alias("n"), es.backoff("id").alias("delay"))


@query("""with recursive s as materialized (select event_type, user_id, t, row_number() over (partition by event_type order by t, user_id::varchar) as n from (select *, epoch_us(ts) / 1e6 as t from events)),
r as (select event_type, n, user_id, 0 as batch, t + 600 as until from s where n = 1
  union all select s.event_type, s.n, s.user_id, r.batch + (s.t > until)::int, case when s.t > until then s.t + 600 else until end from r join s on s.event_type = r.event_type and s.n = r.n + 1)
select event_type, batch::bigint as batch, until as deadline, count(distinct user_id) as paths from r group by all""")
def debounce_batches(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", "ts", F.col("user_id").cast("string").alias("path"))
    return es.debounced(e, "event_type", 600.0)


@query("""with recursive s as materialized (select event_type as client, event_id, t, row_number() over (partition by event_type order by t, event_id) as n from (select *, (epoch_us(ts) // 600) / 1e6 as t from events)),
r as (select client, event_id, n, [t] as log, true as allowed from s where n = 1
  union all select client, event_id, n, case when len(recent) < 70 then list_append(recent, t) else recent end, len(recent) < 70
    from (select s.*, list_filter(r.log, lambda x: x > s.t - 60) as recent from r join s on s.client = r.client and s.n = r.n + 1))
select client, event_id, allowed from r""")
def sliding_rate_limit(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("client"), "event_id", F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 600).cast("long")).alias("ts"))
    return es.rate_limited(e, "client", 60, 10)


@query("""with recursive s as materialized (select key, event_id, t, row_number() over (partition by key order by t, event_id) as n from (select *, event_type || ':' || (user_id % 10) as key, epoch_us(ts) / 1e6 as t from events)),
r as (select key, event_id, n, t as since, false as hit from s where n = 1
  union all select s.key, s.event_id, s.n, case when s.t - since < 7200 then since else s.t end, s.t - since < 7200 from r join s on s.key = r.key and s.n = r.n + 1)
select key, event_id, hit from r""")
def ttl_cache_hits(spark, sf_dir):
    return es.ttl_hits(t(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "event_type", F.col("user_id") % 10)), "key", 7200)


LRU = """with recursive s as materialized (select event_type as shard, event_type || ':' || user_id as key, event_id, t, row_number() over (partition by event_type order by t, event_id) as n from (select *, epoch_us(ts) / 1e6 as t from events)),
r as (select shard, event_id, n, [{'k': key, 'put': t}] as held, false as hit from s where n = 1
  union all select shard, event_id, n, case when hit then list_append(rest, own) else list_append(case when len(rest) >= 100 then rest[2:] else rest end, {'k': key, 'put': t}) end, hit
    from (select *, coalesce(t - own.put < 86400, false) as hit from (select s.*, list_filter(r.held, lambda x: x.k <> s.key) as rest, list_filter(r.held, lambda x: x.k = s.key)[1] as own from r join s on s.shard = r.shard and s.n = r.n + 1)))"""


@query(f"{LRU} select shard, event_id, hit from r")
def lru_cache_hits(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "event_type", "user_id"))
    return es.lru_cache(e, "key", 100, 86400.0, shard="event_type")


@query(f"{LRU} select shard, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses, printf('%.1f%%', 100.0 * count(*) filter (where hit) / count(*)) as hit_rate from r group by shard")
def cache_hit_rate(spark, sf_dir):
    return es.hit_rate(lru_cache_hits(spark, sf_dir), "shard")
