"""Registered queries of the core operators over the driver's tables, and their SQL.

Stand-ins: ``documents`` are source texts and, with ``embeddings`` of the same
number, chunks with vectors (lang as domain, source as parent); conversations
are cases (role as component); pages are noisy text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import chunk, parse, vector
from scriptorium.functions import text as tx
from scriptorium.operators import articles, audit, dedupe, keyword, ranking
from scriptorium.plans import pipelines, providers
from scriptorium.schemas import CASE_FIELDS
from scriptorium.shared import scratch
from scriptorium.sources import store, vectors
from scriptorium.sources.keyword_index import KeywordIndex

QUERY_ID = 0
TARGETS = ["label3", "label5", "label7"]
QUESTION = "the license of this work, version 2.0, er die que est"
#: Cells of the vector index that a query reads.
PROBES = 16
ROLES = ("user", "assistant", "system")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# the query vector is one row, joined in: it is never collected


def _with_query(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where(F.col("vec_id") == QUERY_ID).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q))  # one row


def _nearest(df: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    return ranking.nearest(df, F.col("q"), k, embedding="embedding", id="vec_id", where=where)


def vec_topk(spark, sf):
    return _nearest(_with_query(spark, sf), 50).select("vec_id", F.round("distance", 6).alias("distance"), F.round(vector.distance_score(F.col("distance")), 6).alias("similarity"))


def vec_topk_filtered(spark, sf):
    return _nearest(_with_query(spark, sf), 10, F.col("label") == 3).select("vec_id", "label", F.round("distance", 6).alias("distance"))


def vec_filter_after_topk(spark, sf):
    near = _nearest(_with_query(spark, sf), 50).withColumn("component", F.concat(F.lit("label"), F.col("label")))
    return ranking.keep_components(near, TARGETS, "component").select("vec_id", "component", "component_match", F.round("distance", 6).alias("distance"))


def vec_topk_each(spark, sf):
    """Queries: every vector whose id is divisible by 100, against all."""
    e = table(spark, sf, "embeddings")
    q = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ranking.nearest_each(e, q, 5, id="vec_id").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def _index(spark, sf) -> tuple[vectors.VectorIndex, DataFrame, DataFrame]:
    """An index of all vectors, below the shared folder; the vectors, and the queries, as of ``vec_topk_each``."""
    e = table(spark, sf, "embeddings")
    q = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.VectorIndex.build(e, scratch(spark), id="vec_id"), e, q


def vec_index_exact(spark, sf):
    """The index with all its cells probed: the exact 50 nearest."""
    index, _, q = _index(spark, sf)
    return index.search(q, 50, None, id="vec_id").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def vec_index_recall(spark, sf):
    """How many of the 50 nearest of each query ``PROBES`` cells have."""
    index, e, q = _index(spark, sf)
    exact = ranking.nearest_each(e, q, 50, id="vec_id")
    return vectors.recall(index.search(q, 50, PROBES, id="vec_id"), exact, id="vec_id")


def _wanted() -> Column:
    return F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(c).alias("confidence_score")) for d, c in (("en", 0.9), ("criminal law", 0.7), ("de", 0.3))])


def _domain() -> Column:
    return F.when(F.col("lang") == "fr", F.lit("Criminal Law")).when(F.col("lang") == "es", F.lit("")).otherwise(F.col("lang"))


def domain_boost(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", _domain().alias("domain"))
    return df.select("doc_id", F.round(vector.domain_boost(F.col("domain"), _wanted()), 6).alias("boost"), F.round(vector.chunk_score(F.lit(0.25), F.col("domain"), _wanted()), 6).alias("score"))


def _cases(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source", _domain().alias("domain"), "text")
    near = _nearest(_with_query(spark, sf).join(d, "vec_id"), 50).withColumn("component", F.concat(F.lit("label"), F.col("label")))
    return ranking.scored(ranking.keep_components(near, TARGETS, "component"), _wanted(), domain="domain", component="component")


def case_retrieval(spark, sf):
    top = ranking.parents(_cases(spark, sf), parent="source", id="vec_id", keep=["domain"], k=3)
    top = ranking.ranked(top, F.desc("best_score"), F.asc("first_seen"))
    return top.select(F.col("rank").cast("long").alias("rank"), "source", F.round("best_score", 6).alias("best_score"), "component_matches", "n_chunks", "domain", F.coalesce(ranking.low_confidence(F.col("best_score")), F.lit("")).alias("warning"))


def best_chunk_per_component(spark, sf):
    return ranking.best_chunks(_cases(spark, sf), parent="source", component="component", id="vec_id").select("source", "component", "vec_id", F.round("score", 6).alias("score"), F.array_join("match_reasons", "; ").alias("reasons"))


_BASE_SQL = f"""
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_ID}),
e AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, q)"""
_DOMAIN_SQL = "CASE WHEN lang = 'fr' THEN 'Criminal Law' WHEN lang = 'es' THEN '' ELSE lang END"
_BOOST_SQL = """CASE WHEN domain = '' THEN 0.0 ELSE least(1.0,
  CASE WHEN lower(domain) = 'en' THEN 0.9 WHEN contains(lower(domain), 'en') OR contains('en', lower(domain)) THEN 0.45 ELSE 0.0 END
  + CASE WHEN lower(domain) = 'criminal law' THEN 0.7 WHEN contains(lower(domain), 'criminal law') OR contains('criminal law', lower(domain)) THEN 0.35 ELSE 0.0 END
  + CASE WHEN lower(domain) = 'de' THEN 0.3 WHEN contains(lower(domain), 'de') OR contains('de', lower(domain)) THEN 0.15 ELSE 0.0 END)::DOUBLE END"""
_MULT_SQL = "CASE WHEN " + " OR ".join(f"contains(lower(domain), '{s}')" for s in vector.SUBSTANTIVE) + " THEN 0.5 ELSE 0.2 END::DOUBLE"
_TARGET_SQL = "(" + ", ".join(f"'{t}'" for t in TARGETS) + ")"
_CASES_SQL = f"""WITH {_BASE_SQL},
near AS (SELECT vec_id, 'label' || label AS component, source, {_DOMAIN_SQL} AS domain, d FROM e JOIN documents ON doc_id = vec_id ORDER BY d, vec_id LIMIT 50),
m AS (SELECT *, component IN {_TARGET_SQL} AS hit, bool_or(component IN {_TARGET_SQL}) OVER () AS any_hit FROM near),
s AS (SELECT *, 1 / (1 + d) AS base, {_BOOST_SQL} AS boost FROM m WHERE hit OR NOT any_hit),
c AS (SELECT *, base + {_MULT_SQL} * boost AS score FROM s)"""


# cleaning

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_NAV = "(" + ", ".join(f"'{w}'" for w in tx.NAVIGATION) + ")"
_NAV_LOW = "(" + ", ".join(f"'{w.replace(' ', '').lower()}'" for w in tx.NAVIGATION) + ")"
_IS_NAV = f"(x IN {_NAV} OR lower(replace(x, ' ', '')) IN {_NAV_LOW})"


def _mark_sql(marks) -> str:
    return "(length(x) <= 2 AND (regexp_matches(x, '^\\d+$') OR x IN (" + ", ".join(f"'{m}'" for m in marks) + ")))"


_SYMBOLS = "(length(regexp_replace(x, '[^\\p{L}\\p{N}\\s]', '', 'g')) * 2 < length(x))"
_LINES = "list_filter(list_transform(string_split({}, chr(10)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '')"


def _web_sql(c: str) -> str:
    return _STRIP.format(f"regexp_replace(array_to_string(list_filter({_LINES.format(c)}, lambda x: NOT {_IS_NAV} AND NOT {_mark_sql(tx.MARKS)}), chr(10)), ' +', ' ', 'g')")


def _ocr_sql(c: str) -> str:
    joined = f"regexp_replace(array_to_string(list_filter({_LINES.format(c)}, lambda x: NOT {_IS_NAV} AND NOT {_mark_sql(tx.OCR_MARKS)} AND NOT {_SYMBOLS}), chr(10)), ' +', ' ', 'g')"
    return _STRIP.format(f"regexp_replace(regexp_replace({joined}, '\\|{{2,}}', '', 'g'), '_{{3,}}', '', 'g')")


def _statute_sql(c: str) -> str:
    headers = " OR ".join(f"regexp_matches(x, '(?i){p}')" for p in tx.PAGE_HEADERS)
    inside = "regexp_replace(x, '^\\d+\\s+', '')"
    for p in tx.RUNNING:
        inside = f"regexp_replace({inside}, '(?i){p}', ' ', 'g')"
    inside = _STRIP.format(f"regexp_replace({inside}, '\\s+', ' ', 'g')")
    one = f"CASE WHEN {_IS_NAV} OR {headers} THEN '' WHEN regexp_matches(x, '{tx.CHAPTER_LINE}') OR regexp_matches(x, '{tx.PART_LINE}') THEN x WHEN (regexp_matches(x, '{tx.ROMAN}') AND length(x) <= 10) OR {_mark_sql(tx.OCR_MARKS)} OR {_SYMBOLS} THEN '' ELSE {inside} END"
    return _STRIP.format(f"regexp_replace(array_to_string(list_filter(list_transform({_LINES.format(c)}, lambda x: {one}), lambda x: x <> ''), chr(10)), ' +', ' ', 'g')")


def _noisy(df: DataFrame, text: str) -> Column:
    """Page text with the lines that the cleaners are about."""
    return F.concat(F.lit("Search\n12\n|\nXIV\nCHAPTER ONE\nPart 2 – Rights  of\n[Rev. 2022]\n  7 Some constitution of kenya text \n****--\n"), F.col(text), F.lit("\nskip TO content\n a || b ____ c"))


_NOISY_SQL = "'Search' || chr(10) || '12' || chr(10) || '|' || chr(10) || 'XIV' || chr(10) || 'CHAPTER ONE' || chr(10) || 'Part 2 – Rights  of' || chr(10) || '[Rev. 2022]' || chr(10) || '  7 Some constitution of kenya text ' || chr(10) || '****--' || chr(10) || {} || chr(10) || 'skip TO content' || chr(10) || ' a || b ____ c'"


def clean_v1(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.clean_web(_noisy(d, "text")).alias("clean"))


def clean_v2(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.clean_ocr(_noisy(d, "text")).alias("clean"))


def clean_v3(spark, sf):
    d = table(spark, sf, "pages")
    return d.select("page_id", tx.clean_statute(_noisy(d, "html")).alias("clean"))


def clean_stats(spark, sf):
    d = table(spark, sf, "documents").withColumn("clean", tx.clean_ocr(F.col("text"))).withColumn("kept", tx.cleaned_or_raw(F.col("clean"), F.col("text")))
    return d.select("doc_id", F.length("text").cast("long").alias("raw_size"), F.length("kept").cast("long").alias("clean_size"), F.round(tx.percent_removed(F.col("kept"), F.col("text")), 6).alias("percent_removed"))


# hashes and ids


def doc_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("hash"))


def exact_dups(spark, sf):
    d = table(spark, sf, "documents").groupBy(tx.text_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    return d.where("copies > 1")


def chunk_id(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.chunk_id(F.col("source"), F.col("doc_id"), F.lit(1), F.col("text")).alias("chunk_id"))


def safe_id(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.safe_id(F.col("text"), F.col("lang"), F.col("text")).alias("safe_id"))


def file_parts(spark, sf):
    d = table(spark, sf, "pages")
    return d.select("page_id", tx.stem(F.col("url")).alias("stem"), tx.file_name(F.col("url")).alias("name"), tx.preview(F.col("html")).alias("preview"))


# chunks


def _windows(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("c", chunk.windows(F.col("text")))
    return d.select("doc_id", F.size("c").cast("long").alias("total_chunks"), F.posexplode("c").alias("i", "chunk_text")).select("doc_id", "total_chunks", (F.col("i") + 1).cast("long").alias("chunk_index"), "chunk_text")


def chunk_window(spark, sf):
    return _windows(spark, sf)


def chunk_flatten(spark, sf):
    c = _windows(spark, sf)
    return c.select("doc_id", "chunk_index", F.length("chunk_text").cast("long").alias("chunk_length"), (F.col("total_chunks") == 1).alias("is_complete"))


def chunk_stats(spark, sf):
    c = _windows(spark, sf).withColumn("n", F.length("chunk_text"))
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n"), 6).alias("avg_length"), F.min("n").cast("long").alias("min_length"), F.max("n").cast("long").alias("max_length"))


def chunk_recursive(spark, sf):
    d = table(spark, sf, "documents").withColumn("p", chunk.recursive(F.col("text")))
    return d.select("doc_id", F.size("p").alias("total_chunks"), F.posexplode("p").alias("chunk_index", "p")).select("doc_id", "total_chunks", "chunk_index", F.col("p.start").alias("start_index"), F.col("p.text").alias("chunk_text"))


def chunk_paragraph(spark, sf):
    text = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunk.paragraphs(text)).alias("chunk_index", "chunk_text"))


def chunk_article(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunk.article_windows(F.col("text"))).alias("chunk_index", "chunk_text"))


def chunk_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(chunk.token_chunks(tx.sentences(F.col("text")))).alias("c")).select("doc_id", "c.*")


def chunk_chapters(spark, sf):
    """Each document as a book in which every line opens a chapter."""
    book = F.concat(F.lit("CHAPTER "), F.replace(F.col("text"), F.lit("\n"), F.lit("\nCHAPTER ")))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunk.chapters(book)).alias("part", "body"))


# keyword and hybrid


def _queries(spark) -> DataFrame:
    return spark.range(1).select(F.col("id").cast("int").alias("query_id"), F.lit(QUESTION).alias("query"))


def _keyword(spark, sf, stop, limit) -> DataFrame:
    return keyword.scores(table(spark, sf, "documents").select("doc_id", "text"), _queries(spark), id="doc_id", text="text", query="query_id", query_text="query", stop=stop, limit=limit)


def tfidf_score(spark, sf):
    return _keyword(spark, sf, keyword.STOP_WORDS, 1000).select("doc_id", F.round("keyword", 6).alias("score"))


def tfidf_index(spark, sf):
    """As ``tfidf_score``, from a stored index of which only the question's terms are read."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    index = KeywordIndex.build(d, scratch(spark), id="doc_id", text="text", stop=keyword.STOP_WORDS, limit=1000)
    return index.scores(_queries(spark), query="query_id", query_text="query", id="doc_id").select("doc_id", F.round("keyword", 6).alias("score"))


def tfidf_topk(spark, sf):
    top = keyword.top(_keyword(spark, sf, None, None).withColumn("keyword", F.round("keyword", 9)), "query_id", "keyword", 3, "doc_id")
    return top.select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("keyword", 6).alias("score"))


def hybrid_rank(spark, sf):
    sem = _with_query(spark, sf).select(F.col("vec_id").alias("doc_id"), vector.cosine(F.col("embedding"), F.col("q")).alias("semantic")).join(table(spark, sf, "documents").select("doc_id"), "doc_id").withColumn("query_id", F.lit(0))
    both = sem.join(_keyword(spark, sf, keyword.STOP_WORDS, 1000), ["query_id", "doc_id"], "left").withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    mixed = keyword.hybrid(both, query="query_id").withColumn("hybrid", F.round("hybrid", 9))
    return keyword.top(mixed, "query_id", "hybrid", 10, "doc_id").select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("hybrid", 6).alias("hybrid"))


def _tfidf_sql(stop, limit, source="documents", id="doc_id", text="text") -> str:
    words = "" if not stop else " WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in stop) + ")"
    top = f" ORDER BY sum(tf) DESC, term LIMIT (SELECT least({limit}, 100 * count(*)) FROM {source})" if limit else ""
    grab = "regexp_extract_all(lower({}), '[\\pL\\pN\\pM_][\\pL\\pN\\pM_]+')"
    return f"""
tok AS (SELECT * FROM (SELECT {id} AS doc_id, unnest({grab.format(f"coalesce({text}, '')")}) AS term FROM {source}){words}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term{top}),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN v USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY doc_id),
qt AS (SELECT term, count(*) AS tf FROM (SELECT unnest({grab.format("'" + QUESTION + "'")}) AS term) GROUP BY term),
qw AS (SELECT term, tf * idf AS w FROM qt JOIN v USING (term)),
qn AS (SELECT sqrt(sum(w * w)) AS n FROM qw),
k AS (SELECT doc_id, sum(w.w / norms.n * qw.w / qn.n) AS keyword FROM w JOIN qw USING (term) JOIN norms USING (doc_id), qn GROUP BY doc_id)"""


def dedupe_greedy(spark, sf):
    """Each source's documents, by id, as a ranked list of whole texts."""
    d = table(spark, sf, "documents").select("source", "doc_id", "text", F.col("doc_id").alias("rank"))
    return dedupe.greedy(d, group="source", rank="rank", id="doc_id", text="text").select("source", "doc_id")


# parsing


def _block() -> Column:
    return F.concat(F.lit("Case Title: "), F.col("source"), F.lit(" v B: C\nPARTIES : "), F.col("lang"), F.lit("\n\nYEAR - 20"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit("\nCourt: high\nCOURT LEVEL: "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("\n**JUDGE:** x\nfile name - A-B\nWinner: "), F.col("doc_id").cast("string"))


_BLOCK_SQL = "'Case Title: ' || source || ' v B: C' || chr(10) || 'PARTIES : ' || lang || chr(10) || chr(10) || 'YEAR - 20' || (doc_id % 90 + 10) || chr(10) || 'Court: high' || chr(10) || 'COURT LEVEL: ' || replace(text, chr(10), ' ') || chr(10) || '**JUDGE:** x' || chr(10) || 'file name - A-B' || chr(10) || 'Winner: ' || doc_id"


def parse_metadata(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parse.case_fields(_block()).alias("f")).select("doc_id", "f.*")


def _reply() -> Column:
    # the whole text, in as many even parts as there are sections with a body
    bodies = F.when(F.col("doc_id") % 3 == 0, 4).otherwise(5)
    size = F.ceil(F.length("text") / bodies).cast("int")
    t = lambda k: F.replace(F.substring(F.col("text"), k * size + 1, size), F.lit("\n"), F.lit("\n\n\n\n"))
    last = F.when(bodies == 4, F.lit("")).otherwise(F.concat(F.lit("\n## Section 5 : Conclusion\n"), t(4)))
    return F.concat(F.lit("Intro\n## SECTION 0: METADATA\n"), F.col("source"), F.lit("\n# Section 1 - Facts\n"), t(0), F.lit("\nSECTION 2: ISSUES "), t(1), F.lit("\nSECTION 3: RULES\n"), t(2), F.lit("\n### SECTION 4: APPLICATION\n"), t(3), last)


_BODIES = "CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 5 END"
_T = f"replace(substr(text, {{}} * ceil(length(text) / ({_BODIES})::DOUBLE)::INT + 1, ceil(length(text) / ({_BODIES})::DOUBLE)::INT), chr(10), chr(10) || chr(10) || chr(10) || chr(10))"
_REPLY_SQL = f"'Intro' || chr(10) || '## SECTION 0: METADATA' || chr(10) || source || chr(10) || '# Section 1 - Facts' || chr(10) || {_T.format(0)} || chr(10) || 'SECTION 2: ISSUES ' || {_T.format(1)} || chr(10) || 'SECTION 3: RULES' || chr(10) || {_T.format(2)} || chr(10) || '### SECTION 4: APPLICATION' || chr(10) || {_T.format(3)} || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '## Section 5 : Conclusion' || chr(10) || {_T.format(4)} END"


def extract_sections(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _reply().alias("reply")).select("doc_id", parse.sections(F.col("reply")).alias("s")).select("doc_id", "s.*")


def _section_sql(i: int) -> str:
    header = lambda k: rf"(?i)(#+\s*)?SECTION\s*{k}\s*[:\-]\s*{parse.SECTIONS[k].upper()}"
    m = f"regexp_extract(r, '{header(i)}')"
    body = f"substr(r, instr(r, {m}) + length({m}))"
    if i + 1 < len(parse.SECTIONS):
        n = f"regexp_extract({body}, '{header(i + 1)}')"
        body = f"CASE WHEN {n} <> '' THEN substr({body}, 1, instr({body}, {n}) - 1) ELSE {body} END"
    text = _STRIP.format(f"regexp_replace({_STRIP.format(body)}, '\\n{{3,}}', chr(10) || chr(10), 'g')")
    return f"CASE WHEN {m} = '' THEN '' ELSE {text} END AS {parse.SECTIONS[i]}"


def classification(spark, sf):
    """Domains as strings in one half of the replies and as objects in the other; some lack keys."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    objects = F.concat(F.lit('[{"domain":"'), F.col("lang"), F.lit('","confidence_score":0.25},{"domain":"x"}]'))
    domains = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('["'), F.col("lang"), F.lit('"]'))).otherwise(objects)
    summary = F.when(F.col("doc_id") % 5 == 0, "").otherwise(',"reasoning_summary":"r"')
    reply = F.concat(F.lit('```json\n{"intents":["i"],"target_components":["FACTS","'), F.col("source"), F.lit('"],"legal_domains":'), domains, F.lit(',"vector_query":"'), F.col("source"), F.lit('"'), summary, F.lit("}\n```"))
    c = d.select("doc_id", parse.classification(reply).alias("c"), parse.missing_keys(reply).alias("missing"))
    named = F.transform("c.legal_domains", lambda x: F.concat(x["domain"], F.lit("="), F.format_string("%.2f", x["confidence_score"])))
    return c.select("doc_id", F.array_join("c.target_components", ",").alias("targets"), F.array_join(named, ",").alias("domains"), F.col("c.vector_query").alias("vector_query"), F.array_join("missing", ",").alias("missing"))


# statutes


def _statute() -> Column:
    def line(x: Column, i: Column) -> Column:
        n = (F.floor(i / 4) + 1).cast("string")
        return F.when(i % 11 == 0, F.concat(F.lit("CHAPTER "), i.cast("string"), F.lit("\n\n"), x)).when(i % 7 == 3, F.concat(F.lit("Part "), i.cast("string"), F.lit(" – "), x)).when(i % 2 == 1, F.concat(n, F.lit(". "), x)).otherwise(x)

    return F.array_join(F.transform(F.split("text", "\n"), line), "\n")


def article_segment(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _statute().alias("body"))
    out = articles.segmented(d, id="doc_id", text="body")
    return out.withColumn("article", F.col("article").cast("long"))


_STATUTE_SQL = """
raw AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    CASE WHEN (i - 1) % 11 = 0 THEN 'CHAPTER ' || (i - 1) || chr(10) || chr(10) || x
         WHEN (i - 1) % 7 = 3 THEN 'Part ' || (i - 1) || ' – ' || x
         WHEN (i - 1) % 2 = 1 THEN ((i - 1) // 4 + 1) || '. ' || x ELSE x END), chr(10)) AS body FROM documents),
l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS n FROM raw),
s AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(s, '(?i)^PART\\s+(\\d+)\\s*[–-]\\s*(.+)') THEN 'p' WHEN regexp_matches(s, '(?i)^CHAPTER\\s+(.+)') THEN 'c' WHEN regexp_matches(s, '^(\\d+)\\.\\s+(.+)') THEN 'a' END AS kind FROM s),
e AS (SELECT *, CASE WHEN kind = 'a' THEN regexp_extract(s, '^(\\d+)\\.\\s+(.+)', 1) END AS number, CASE WHEN kind IS NOT NULL THEN n END AS event,
             CASE WHEN s <> '' THEN n END AS solid FROM k),
f AS (SELECT *, max(event) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_n,
             max(event) OVER (PARTITION BY doc_id ORDER BY n) AS now_n,
             min(solid) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_n,
             coalesce(lag(s, 1) OVER (PARTITION BY doc_id ORDER BY n), '') AS one, coalesce(lag(s, 2) OVER (PARTITION BY doc_id ORDER BY n), '') AS two,
             max(CASE WHEN kind = 'c' THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS chap_n,
             max(CASE WHEN kind IN ('p', 'c') THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS part_n FROM e),
g AS (SELECT f.*, a.kind AS now_kind, CASE WHEN f.kind = 'a' AND NOT coalesce(b.kind = 'a' AND b.number = f.number, false) THEN 1 ELSE 0 END AS starts
      FROM f LEFT JOIN e a ON a.doc_id = f.doc_id AND a.n = f.now_n LEFT JOIN e b ON b.doc_id = f.doc_id AND b.n = f.last_n),
h AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY n) AS article FROM g),
t AS (SELECT doc_id, article, min(n) AS n, string_agg(raw, chr(10) ORDER BY n) FILTER (s <> '') AS full_article_text FROM h WHERE now_kind = 'a' AND article <= 264 GROUP BY doc_id, article)
SELECT t.doc_id, t.article::BIGINT AS article, h.number, CASE WHEN h.one <> '' THEN h.one ELSE h.two END AS header, regexp_extract(h.s, '^(\\d+)\\.\\s+(.+)', 2) AS sentence, full_article_text,
  CASE WHEN p.kind = 'p' THEN regexp_extract(p.s, '(?i)^PART\\s+(\\d+)\\s*[–-]\\s*(.+)', 1) END AS part,
  CASE WHEN p.kind = 'p' THEN trim(regexp_extract(p.s, '(?i)^PART\\s+(\\d+)\\s*[–-]\\s*(.+)', 2)) END AS part_title,
  trim(regexp_extract(c.s, '(?i)^CHAPTER\\s+(.+)', 1)) AS chapter,
  CASE WHEN x.kind IN ('p', 'a') THEN NULL ELSE x.s END AS chapter_title
FROM t JOIN h ON h.doc_id = t.doc_id AND h.n = t.n LEFT JOIN h p ON p.doc_id = t.doc_id AND p.n = h.part_n LEFT JOIN h c ON c.doc_id = t.doc_id AND c.n = h.chap_n
LEFT JOIN h x ON x.doc_id = t.doc_id AND x.n = c.next_n"""


# audits


def component_counts(spark, sf):
    return audit.component_counts(table(spark, sf, "conversations"), "role", ROLES)


def audit_missing_components(spark, sf):
    return audit.missing_components(table(spark, sf, "conversations"), "conv_id", "role", ROLES).select("conv_id", "n_chunks", F.array_join("missing", ",").alias("missing"))


def audit_missing_fields(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", parse.case_fields(_block()).alias("f")).select("doc_id", "f.*").withColumn("n", audit.populated())
    return audit.missing_fields(d).select("doc_id", F.array_join("missing_fields", ",").alias("missing"), F.col("n").cast("long").alias("populated"), F.coalesce(audit.field_warning(F.col("n")), F.lit("")).alias("warning"))


def audit_sequence(spark, sf):
    """All turns; those of each seventh conversation skip an index."""
    c = table(spark, sf, "conversations").withColumn("i", (F.col("turn") + F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") >= 1), 2).otherwise(1)).cast("int"))
    n = c.groupBy("conv_id").agg(F.max("i").alias("stated"))
    return audit.sequences(c.join(n, "conv_id"), "conv_id", "i", "stated").withColumn("n", F.col("n").cast("long"))


def completeness(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("article_number"), F.col("role").alias("chapter"), F.when(F.col("turn") > 2, F.col("turn").cast("string")).otherwise("").alias("part"), (F.col("turn") == 5).alias("is_complete_article"), F.col("text").alias("chunk_text"))
    return audit.completeness(c).select(*[F.round(k, 6).alias(k) if k == "avg_length" else F.col(k).cast("long").alias(k) for k in ("chunks", "chapters", "parts", "articles", "avg_length", "min_length", "max_length", "complete_articles", "partial_articles")])


def embedding_stats(spark, sf):
    e, v = table(spark, sf, "embeddings"), F.col("embedding")
    return e.select("vec_id", F.size(v).cast("long").alias("dim"), F.round(vector.mean(v), 6).alias("mean"), F.round(vector.std(v), 6).alias("std"), F.round(vector.norm(v), 5).alias("norm"))


def ingest_status(spark, sf):
    status = F.when(F.length("text") < 20, "failed").when(F.col("doc_id") % 3 == 0, "skipped").otherwise("ingested")
    return audit.ingest_stats(table(spark, sf, "documents").withColumn("status", status), by=["source"])


def article_order(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("A"))).otherwise(F.col("doc_id").cast("string")).alias("number"))
    return d.orderBy(*articles.numeric_first("number"))


# store


def _stored(spark, sf) -> DataFrame:
    """Labelled documents, those of quality 0 with an outdated hash, and the pages, which no document replaces."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf, "documents").join(labels, "doc_id").select("doc_id", "source", "text", F.when(F.col("quality") == 0, "old").otherwise(tx.text_hash(F.col("text"))).alias("hash"))
    p = table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("url").alias("source"), F.col("html").alias("text"), tx.text_hash(F.col("html")).alias("hash"))
    return d.unionByName(p)


def _incoming(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", "source", F.concat(F.lit("new "), F.col("text")).alias("text"), tx.text_hash(F.col("text")).alias("hash"))


def skip_existing(spark, sf):
    return store.absent(_incoming(spark, sf), _stored(spark, sf), "doc_id").select("doc_id", "hash")


def change_detection(spark, sf):
    return store.changed(_incoming(spark, sf).select("doc_id", "hash"), _stored(spark, sf), "doc_id", "hash")


def upsert_by_group(spark, sf):
    return store.upserted(_stored(spark, sf), _incoming(spark, sf), "doc_id").select("doc_id", F.length("text").cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


def delete_by_predicate(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(~(F.col("lang") == "de")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def point_lookup(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.col("doc_id").isin(3, 5, 8, 1_000_000_000)).select("doc_id", "lang")


def semi_join_lookup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


# answers


def context_format(spark, sf):
    """Every three documents, whole, as the hits of one query."""
    rank = (F.col("doc_id") % 3 + 1).cast("int")
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 3).alias("query_id"), rank.alias("rank"), (1 / (F.col("doc_id") + 1.3).cast("double")).alias("rerank"), "text", "source", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("int")).alias("start_index"))
    return pipelines.context(d)


def summary_fallback(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("component"), "text"))).alias("c"))
    chunks = F.transform("c", lambda x: F.struct(x["component"].alias("component"), x["text"].alias("text")))
    return c.select("conv_id", pipelines.summary_fallback(F.concat(F.lit("Case "), F.col("conv_id").cast("string")), chunks).alias("summary"))


def case_chunks(spark, sf):
    """Extraction replies to component rows: parse, unpivot, hash, identify."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("document"), _block().alias("metadata"), _reply().alias("reply")).withColumn("s", parse.sections(F.col("reply")))
    cases = d.select("document", "metadata", *[F.col(f"s.{c}").alias(c) for c in ("facts", "issues", "rules", "application", "conclusion")], F.col("doc_id").cast("string").alias("source_file_path"), F.lit(None).cast("string").alias("error"))
    return pipelines.case_chunks(cases).select("source_file_path", "firac_component", "case_identifier", "content_length", "document_hash", *CASE_FIELDS[1:3])


def corpus_stats(spark, sf):
    c = table(spark, sf, "documents").select(F.size(keyword.terms(F.col("text"))).alias("token_count"))
    return pipelines.corpus_stats(c).select("chunks", F.col("min_tokens").cast("long").alias("min_tokens"), F.col("max_tokens").cast("long").alias("max_tokens"), F.round("avg_tokens", 6).alias("avg_tokens"))


def chapter_counts(spark, sf):
    return pipelines.chapter_counts(table(spark, sf, "documents").withColumn("chapter_no", (F.col("doc_id") % 12).cast("int")))


def payload_flatten(spark, sf):
    field = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content"), F.col("lang").alias("metadata")))).when(F.col("doc_id") % 3 != 0, F.col("source"))
    content, metadata = parse.payload(field)
    return table(spark, sf, "documents").select("doc_id", content.alias("content"), metadata.alias("metadata"))


def retrieval_stats(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    near = _nearest(_with_query(spark, sf).join(d, "vec_id"), 50).withColumn("component", F.concat(F.lit("label"), F.col("label")))
    kept = ranking.scored(ranking.keep_components(near, TARGETS, "component").withColumn("domain", F.lit("")), _wanted(), domain="domain", component="component")
    return pipelines.retrieval_stats(near, kept, ranking.parents(kept, parent="source", id="vec_id", keep=[]), "source")


def keyword_hits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return pipelines.keyword_hits(d, _queries(spark), id="doc_id").withColumn("score", F.round("score", 6))


def near_text(spark, sf):
    """Chunk search end to end with the stand-in models: blend, rerank, near-duplicates out."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.lit(0).alias("start_index"))
    embed = providers.hashed(32)
    chunks = d.withColumn("embedding", providers.embedded(F.col("text"), embed))
    return pipelines.search_chunks(chunks, _queries(spark), embed).select("query_id", "id", "rank", F.round("hybrid", 6).alias("hybrid"), F.round("rerank", 6).alias("rerank"))


_NAMES = """vec_index_exact vec_index_recall tfidf_index vec_topk vec_topk_filtered vec_filter_after_topk vec_topk_each domain_boost case_retrieval best_chunk_per_component clean_v1 clean_v2
clean_v3 clean_stats doc_hash exact_dups chunk_id safe_id file_parts chunk_window chunk_flatten chunk_stats chunk_recursive chunk_paragraph chunk_article
chunk_tokens chunk_chapters tfidf_score tfidf_topk hybrid_rank dedupe_greedy parse_metadata extract_sections classification article_segment component_counts
audit_missing_components audit_missing_fields audit_sequence completeness embedding_stats ingest_status article_order skip_existing change_detection
corpus_stats chapter_counts payload_flatten retrieval_stats keyword_hits near_text upsert_by_group delete_by_predicate point_lookup semi_join_lookup context_format summary_fallback case_chunks""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_PARAGRAPHS_SQL = f"""p AS (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents),
s AS (SELECT doc_id, 1 AS i, ps[1] AS cur, NULL::VARCHAR AS out FROM p
      UNION ALL
      SELECT doc_id, i + 1,
             CASE WHEN kept = '' THEN ps[i + 1] ELSE kept || chr(10) || chr(10) || ps[i + 1] END, CASE WHEN over THEN cur END
      FROM (SELECT *, CASE WHEN over THEN right(cur, {chunk.PARAGRAPH_OVERLAP}) ELSE cur END AS kept
            FROM (SELECT doc_id, i, cur, ps, cur <> '' AND length(cur) + length(ps[i + 1]) > {chunk.SIZE} AS over FROM s JOIN p USING (doc_id) WHERE i < len(ps)))),
o AS (SELECT doc_id, i, out AS t FROM s WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM s JOIN p USING (doc_id) WHERE i = len(ps) AND cur <> ''),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, t AS chunk_text FROM o)"""
_ARTICLE_WINDOWS_SQL = f"""s AS (
  SELECT doc_id, text, 0 AS i, 0 AS a, CASE WHEN length(text) <= {chunk.SIZE} THEN length(text) ELSE {{end}} END AS b FROM (SELECT doc_id, text, 0 AS a FROM documents)
  UNION ALL
  SELECT doc_id, text, i, a, {{end}} FROM (SELECT doc_id, text, i + 1 AS i, b - {chunk.OVERLAP} AS a FROM s WHERE length(text) > {chunk.SIZE} AND b - {chunk.OVERLAP} < length(text)))""".replace(
    "{end}", f"a + CASE WHEN a + {chunk.SIZE} < length(text) AND length(regexp_extract(substr(text, a + 1, {chunk.SIZE}), '(?s)^(.*) ', 1)) > {chunk.OVERLAP} THEN length(regexp_extract(substr(text, a + 1, {chunk.SIZE}), '(?s)^(.*) ', 1)) ELSE {chunk.SIZE} END"
)
_CHAPTERS_SQL = f"""p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: 'CHAPTER ' || x || CASE WHEN i < len(string_split(text, chr(10))) THEN chr(10) ELSE '' END) AS ps, length(text) + 8 * len(string_split(text, chr(10))) AS n FROM documents),
s AS (SELECT doc_id, 1 AS i, ps[1] AS cur, NULL::VARCHAR AS out FROM p
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN over THEN ps[i + 1] ELSE cur || ps[i + 1] END, CASE WHEN over THEN cur END
      FROM (SELECT doc_id, i, cur, ps, n > {chunk.CONTEXT} AND length(cur) + length(ps[i + 1]) >= {chunk.CONTEXT} AS over FROM s JOIN p USING (doc_id) WHERE i < len(ps))),
o AS (SELECT doc_id, i, out AS t FROM s WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM s JOIN p USING (doc_id) WHERE i = len(ps)),
c AS (SELECT doc_id, i, {_STRIP.format("t")} AS body FROM o)"""
#: Pairs of similar documents of a source first, then a step a rank: who stays depends on who has stayed.
_GREEDY_SQL = r"""w AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS ws FROM documents),
u AS (SELECT source, k, len(ws) AS n, unnest(ws) AS word FROM w),
e AS (SELECT source, k, list(j) AS likes
      FROM (SELECT a.source, a.k AS j, b.k AS k, count(*) AS shared, greatest(a.n, b.n) AS most FROM u a JOIN u b ON a.source = b.source AND a.word = b.word AND a.k < b.k
            WHERE least(a.n, b.n) > {t} * greatest(a.n, b.n) GROUP BY ALL)
      WHERE shared / most > {t} GROUP BY source, k),
s AS (SELECT source, 0::BIGINT AS k, []::BIGINT[] AS kept FROM w GROUP BY source
      UNION ALL
      SELECT s.source, s.k + 1, CASE WHEN likes IS NULL OR len(list_intersect(likes, kept)) = 0 THEN list_append(kept, s.k + 1) ELSE kept END
      FROM s JOIN w ON w.source = s.source AND w.k = s.k + 1 LEFT JOIN e ON e.source = s.source AND e.k = s.k + 1)""".format(t=dedupe.THRESHOLD)

_WINDOWS_SQL = f"""w AS (SELECT doc_id, greatest(0, ceil((length(text) - {chunk.SIZE}) / {chunk.SIZE - chunk.OVERLAP}.0))::INT AS last, text FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, last + 1 AS total, i + 1 AS i, substr(text, i * {chunk.SIZE - chunk.OVERLAP} + 1, {chunk.SIZE}) AS t FROM (SELECT *, unnest(range(last + 1)) AS i FROM w))"""
_HASH = "CASE WHEN text <> '' THEN sha256(text) ELSE '' END"
_STORED = f"""labelled AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
stored AS (SELECT doc_id, source, text, CASE WHEN quality = 0 THEN 'old' ELSE {_HASH} END AS hash FROM documents JOIN labelled USING (doc_id)
           UNION ALL SELECT -1 - page_id, url, html, sha256(html) FROM pages),
incoming AS (SELECT doc_id, source, 'new ' || text AS text, {_HASH} AS hash FROM documents)"""


def _fields_sql() -> str:
    pair = "^([^:]+)[:\\-]\\s*(.+)$"
    out = [f"lines AS (SELECT doc_id, list_filter({_LINES.format(_BLOCK_SQL)}, lambda x: regexp_matches(x, '{pair}')) AS ls FROM documents)"]
    out.append(f"pairs AS (SELECT doc_id, list_transform(ls, lambda x: {{'k': replace(lower({_STRIP.format(f'''regexp_extract(x, '{pair}', 1)''')}), ' ', '_'), 'v': {_STRIP.format(f'''regexp_extract(x, '{pair}', 2)''')}}}) AS ps FROM lines)")
    cols = [f"coalesce(list_filter(ps, lambda p: p.k IN ({', '.join(repr(a) for a in parse.ALIASES[f])}))[-1].v, '') AS {f}" for f in CASE_FIELDS]
    out.append(f"fields AS (SELECT doc_id, {', '.join(cols)} FROM pairs)")
    return ", ".join(out)


ORACLE_SQL = {
    "vec_topk": f"WITH {_BASE_SQL} SELECT vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM e ORDER BY d, vec_id LIMIT 50",
    "vec_topk_filtered": f"WITH {_BASE_SQL} SELECT vec_id, label, round(d, 6) AS distance FROM e WHERE label = 3 ORDER BY d, vec_id LIMIT 10",
    "vec_filter_after_topk": f"WITH {_BASE_SQL}, t AS (SELECT vec_id, 'label' || label AS component, d FROM e ORDER BY d, vec_id LIMIT 50) SELECT vec_id, component, component IN {_TARGET_SQL} AS component_match, round(d, 6) AS distance FROM t WHERE component IN {_TARGET_SQL} OR NOT EXISTS (SELECT 1 FROM t WHERE component IN {_TARGET_SQL})",
    "vec_topk_each": "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM r WHERE rank <= 5",
    "domain_boost": f"WITH d AS (SELECT doc_id, {_DOMAIN_SQL} AS domain FROM documents), b AS (SELECT *, {_BOOST_SQL} AS boost FROM d) SELECT doc_id, round(boost, 6) AS boost, round(1 / 1.25::DOUBLE + {_MULT_SQL} * boost, 6) AS score FROM b",
    "case_retrieval": f"{_CASES_SQL}, g AS (SELECT source, max(score) AS best, count_if(hit) AS m, count(*) AS n, min({{'d': d, 'v': vec_id}}) AS seen, arg_min(domain, {{'d': d, 'v': vec_id}}) AS domain FROM c GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY best DESC, seen) AS rank FROM g) SELECT rank, source, round(best, 6) AS best_score, m::BIGINT AS component_matches, n AS n_chunks, domain, CASE WHEN best < 0.5 THEN 'Low confidence: the best match scores under 0.5' ELSE '' END AS warning FROM r WHERE rank <= 3",
    "best_chunk_per_component": f"{_CASES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source, component ORDER BY score DESC, d, vec_id) AS p FROM c) SELECT source, component, vec_id, round(score, 6) AS score, CASE WHEN base <= 0.5 AND NOT hit AND boost <= 0 THEN 'Basic relevance' ELSE array_to_string(list_filter([CASE WHEN base > 0.7 THEN 'High semantic similarity' WHEN base > 0.5 THEN 'Moderate semantic similarity' END, CASE WHEN hit THEN 'Target component match (' || upper(component) || ')' END, CASE WHEN boost > 0 THEN 'Legal domain overlap (boost: +' || printf('%.2f', boost) || ')' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM r WHERE p = 1",
    "clean_v1": f"SELECT doc_id, {_web_sql('(' + _NOISY_SQL.format('text') + ')')} AS clean FROM documents",
    "clean_v2": f"SELECT doc_id, {_ocr_sql('(' + _NOISY_SQL.format('text') + ')')} AS clean FROM documents",
    "clean_v3": f"SELECT page_id, {_statute_sql('(' + _NOISY_SQL.format('html') + ')')} AS clean FROM pages",
    "clean_stats": f"WITH c AS (SELECT doc_id, text, {_ocr_sql('text')} AS clean FROM documents), k AS (SELECT doc_id, text, CASE WHEN {_STRIP.format('clean')} = '' THEN text ELSE clean END AS kept FROM c) SELECT doc_id, length(text) AS raw_size, length(kept) AS clean_size, CASE WHEN length(text) > 0 THEN round((length(text) - length(kept)) * 100.0::DOUBLE / length(text), 6) ELSE 0 END AS percent_removed FROM k",
    "doc_hash": f"SELECT doc_id, {_HASH} AS hash FROM documents",
    "exact_dups": f"SELECT {_HASH} AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "chunk_id": "SELECT doc_id, 'const_' || source || '_art' || doc_id || '_chunk1_' || substr(sha256(text), 1, 8) AS chunk_id FROM documents",
    "safe_id": "SELECT doc_id, concat_ws('_', substr(regexp_replace(text, '[^A-Za-z0-9_-]', '_', 'g'), 1, 50), lang, substr(sha256(text), 1, 8)) AS safe_id FROM documents",
    "file_parts": r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN length(html) > 200 THEN substr(html, 1, 200) || '...' ELSE html END AS preview FROM pages",
    "chunk_window": f"WITH {_WINDOWS_SQL} SELECT doc_id, total::BIGINT AS total_chunks, i::BIGINT AS chunk_index, t AS chunk_text FROM c",
    "chunk_flatten": f"WITH {_WINDOWS_SQL} SELECT doc_id, i::BIGINT AS chunk_index, length(t) AS chunk_length, total = 1 AS is_complete FROM c",
    "chunk_stats": f"WITH {_WINDOWS_SQL} SELECT count(*) AS chunks, round(avg(length(t)), 6) AS avg_length, min(length(t)) AS min_length, max(length(t)) AS max_length FROM c",
    "vec_index_exact": "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM r WHERE rank <= 50",
    "chunk_paragraph": f"WITH RECURSIVE {_PARAGRAPHS_SQL} SELECT doc_id, chunk_index::INT AS chunk_index, chunk_text FROM c",
    "chunk_article": f"WITH RECURSIVE {_ARTICLE_WINDOWS_SQL} SELECT doc_id, i AS chunk_index, CASE WHEN length(text) <= {chunk.SIZE} THEN text ELSE {_STRIP.format('substr(text, a + 1, b - a)')} END AS chunk_text FROM s",
    "chunk_chapters": f"WITH RECURSIVE {_CHAPTERS_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS part, body FROM c WHERE body <> ''",
    "dedupe_greedy": f"WITH RECURSIVE {_GREEDY_SQL}, f AS (SELECT source, unnest(arg_max(kept, k)) AS k FROM s GROUP BY source) SELECT source, doc_id FROM f JOIN w USING (source, k)",
    "keyword_hits": f"WITH RECURSIVE {_PARAGRAPHS_SQL.replace('p AS (', 'p AS MATERIALIZED (', 1)}, chunks AS (SELECT doc_id || '#' || lpad(chunk_index::VARCHAR, 8, '0') AS chunk_id, chunk_text FROM c), {_tfidf_sql(None, None, 'chunks', 'chunk_id', 'chunk_text')}, r AS (SELECT doc_id AS chunk_id, keyword, row_number() OVER (ORDER BY round(keyword, 9) DESC, doc_id DESC) AS rank FROM k) SELECT 0 AS query_id, rank::INT AS rank, chunk_id, round(keyword, 6) AS score, chunk_text FROM r JOIN chunks USING (chunk_id) WHERE rank <= 3",
    "case_chunks": f"WITH {_fields_sql()}, x AS (SELECT doc_id, text, {_REPLY_SQL} AS r FROM documents), s AS (SELECT doc_id, text, {', '.join(_section_sql(i) for i in range(6))} FROM x), u AS (SELECT doc_id, text, unnest(['facts', 'issues', 'rules', 'application', 'conclusion']) AS firac_component, unnest([facts, issues, rules, application, conclusion]) AS body FROM s) SELECT doc_id::VARCHAR AS source_file_path, firac_component, CASE WHEN file_name <> '' THEN file_name ELSE 'case_' || substr({_HASH}, 1, 16) END AS case_identifier, length(body) AS content_length, {_HASH} AS document_hash, parties, court_level FROM u JOIN fields USING (doc_id) WHERE body <> ''",
    "tfidf_index": f"WITH {_tfidf_sql(keyword.STOP_WORDS, 1000)} SELECT doc_id, round(keyword, 6) AS score FROM k",
    "tfidf_score": f"WITH {_tfidf_sql(keyword.STOP_WORDS, 1000)} SELECT doc_id, round(keyword, 6) AS score FROM k",
    "tfidf_topk": f"WITH {_tfidf_sql(None, None)}, r AS (SELECT doc_id, keyword, row_number() OVER (ORDER BY round(keyword, 9) DESC, doc_id DESC) AS rank FROM k) SELECT doc_id, rank, round(keyword, 6) AS score FROM r WHERE rank <= 3",
    "hybrid_rank": f"WITH {_BASE_SQL}, {_tfidf_sql(keyword.STOP_WORDS, 1000)}, b AS (SELECT doc_id, 1 - d AS s, coalesce(keyword, 0) AS kw FROM e JOIN documents ON doc_id = vec_id LEFT JOIN k USING (doc_id)), x AS (SELECT min(s) AS ls, max(s) AS hs, min(kw) AS lk, max(kw) AS hk FROM b), h AS (SELECT doc_id, 0.7::DOUBLE * CASE WHEN hs - ls > 1e-8 THEN (s - ls) / (hs - ls) ELSE 1 END + 0.3::DOUBLE * CASE WHEN hk - lk > 1e-8 THEN (kw - lk) / (hk - lk) ELSE 0 END AS hybrid FROM b, x), r AS (SELECT *, row_number() OVER (ORDER BY round(hybrid, 9) DESC, doc_id DESC) AS rank FROM h) SELECT doc_id, rank, round(hybrid, 6) AS hybrid FROM r WHERE rank <= 10",
    "parse_metadata": f"WITH {_fields_sql()} SELECT * FROM fields",
    "extract_sections": f"WITH x AS (SELECT doc_id, {_REPLY_SQL} AS r FROM documents) SELECT doc_id, {', '.join(_section_sql(i) for i in range(6))} FROM x",
    "classification": "SELECT doc_id, 'FACTS,' || source AS targets, CASE WHEN doc_id % 2 = 0 THEN lang || '=0.50' ELSE lang || '=0.25,x=0.50' END AS domains, source AS vector_query, CASE WHEN doc_id % 5 = 0 THEN 'reasoning_summary' ELSE '' END AS missing FROM documents",
    "article_segment": f"WITH {_STATUTE_SQL}",
    "component_counts": "SELECT r AS component, (SELECT count(*) FROM conversations WHERE role = r) AS n FROM (SELECT unnest(['user', 'assistant', 'system']) AS r)",
    "audit_missing_components": "SELECT conv_id, count(*) AS n_chunks, array_to_string(list_filter(['user', 'assistant', 'system'], lambda x: NOT list_contains(list(role), x)), ',') AS missing FROM conversations GROUP BY conv_id",
    "audit_missing_fields": f"WITH {_fields_sql()}, m AS (SELECT doc_id, list_filter([{', '.join(f'''CASE WHEN {f} = '' THEN '{f}' END''' for f in CASE_FIELDS)}], lambda x: x IS NOT NULL) AS miss FROM fields) SELECT doc_id, array_to_string(miss, ',') AS missing, {len(CASE_FIELDS)} - len(miss) AS populated, CASE WHEN len(miss) = {len(CASE_FIELDS)} THEN 'no metadata' WHEN {len(CASE_FIELDS)} - len(miss) < 4 THEN 'little metadata' ELSE '' END AS warning FROM m",
    "audit_sequence": "WITH c AS (SELECT conv_id, turn + CASE WHEN conv_id % 7 = 0 AND turn >= 1 THEN 2 ELSE 1 END AS i FROM conversations) SELECT conv_id, count(*) AS n, list(i ORDER BY i) = range(1, count(*) + 1) AS indices_ok, max(i) = count(*) AS total_ok FROM c GROUP BY conv_id",
    "completeness": "WITH a AS (SELECT conv_id, bool_or(turn = 5) AS whole FROM conversations GROUP BY conv_id) SELECT count(*) AS chunks, count(DISTINCT CASE WHEN role <> '' THEN role END) AS chapters, count(DISTINCT CASE WHEN turn > 2 THEN turn END) AS parts, count(DISTINCT conv_id) AS articles, round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length, (SELECT count(*) FROM a WHERE whole) AS complete_articles, (SELECT count(*) FROM a WHERE NOT whole) AS partial_articles FROM conversations",
    "embedding_stats": "SELECT vec_id, len(embedding) AS dim, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(list_stddev_pop(embedding::DOUBLE[]), 6) AS std, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings",
    "ingest_status": "WITH s AS (SELECT source, CASE WHEN length(text) < 20 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'ingested' END AS st FROM documents), c AS (SELECT source, count(*) AS total, count_if(st = 'ingested')::BIGINT AS ingested, count_if(st = 'skipped')::BIGINT AS skipped, count_if(st = 'failed')::BIGINT AS failed FROM s GROUP BY source) SELECT *, CASE WHEN ingested + skipped = 0 THEN 'failed' WHEN failed > 0 THEN 'partial_success' ELSE 'success' END AS overall FROM c",
    "article_order": "SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id || 'A' ELSE doc_id::VARCHAR END AS number FROM documents ORDER BY try_cast(number AS INT) NULLS LAST, number",
    "skip_existing": f"WITH {_STORED} SELECT doc_id, hash FROM incoming WHERE doc_id NOT IN (SELECT doc_id FROM stored)",
    "change_detection": f"WITH {_STORED} SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.doc_id = i.doc_id AND s.hash = i.hash) THEN 'skipped' ELSE 'ingested' END AS status FROM incoming i",
    "upsert_by_group": f"WITH {_STORED}, u AS (SELECT doc_id, text FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM incoming) UNION ALL SELECT doc_id, text FROM incoming) SELECT doc_id, length(text) AS n, sha256(text) AS text_hash FROM u",
    "delete_by_predicate": "SELECT source, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY source",
    "point_lookup": "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8, 1000000000)",
    "semi_join_lookup": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "context_format": "WITH d AS (SELECT doc_id // 3 AS query_id, doc_id % 3 + 1 AS rank, 1 / (doc_id + 1.3)::DOUBLE AS r, text AS t, source, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'Unknown' END AS st FROM documents) SELECT query_id, string_agg('[Chunk ' || rank || ' - Relevance Score: ' || printf('%.4f', r) || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY rank) AS context, string_agg('[' || rank || '] ' || source || ' (start ' || st || ')', chr(10) ORDER BY rank) AS citations FROM d GROUP BY query_id",
    "corpus_stats": "WITH t AS (SELECT len(regexp_extract_all(lower(text), '[\\pL\\pN\\pM_][\\pL\\pN\\pM_]+')) AS n FROM documents) SELECT count(*) AS chunks, min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n), 6) AS avg_tokens FROM t",
    "chapter_counts": "SELECT (doc_id % 12)::INT AS chapter_no, count(*) AS articles FROM documents GROUP BY 1",
    "payload_flatten": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS content, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS metadata FROM documents",
    "retrieval_stats": f"WITH {_BASE_SQL}, near AS (SELECT vec_id, source, 'label' || label AS component FROM e JOIN documents ON doc_id = vec_id ORDER BY d, vec_id LIMIT 50), k AS (SELECT * FROM near WHERE component IN {_TARGET_SQL} OR NOT EXISTS (SELECT 1 FROM near WHERE component IN {_TARGET_SQL})) SELECT (SELECT count(*) FROM near) AS total_candidates, count(*) AS after_component_filter, count(DISTINCT source) AS unique_parents_found, least(3, count(DISTINCT source)) AS returned_parents FROM k",
    "summary_fallback": "WITH c AS (SELECT conv_id, upper(role) || ': ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations) SELECT conv_id, 'Case ' || conv_id || chr(10) || string_agg('- ' || l, chr(10) ORDER BY i) AS summary FROM c WHERE i <= 3 GROUP BY conv_id",
}
