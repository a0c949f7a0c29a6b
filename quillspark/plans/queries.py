"""Queries over the driver's tables, one or more for each operator, with SQL that gives the same rows.

documents stand for a corpus of files: rel_path = lang/source/doc_id.md, body = text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import index, query
from quillspark.operators.audit import verify
from quillspark.operators.snippets import best_fragments, preview
from quillspark.plans.percolate import fits, trees
from quillspark.plans.search import Corpus, matches, search
from quillspark.plans.store import Store
from quillspark.sources.config import Config
from quillspark.sources.tree import path_wanted
from quillspark.streaming.upserts import rate_limited, resolve

QUERIES, SQL = {}, {}
FIELDS = ("body", "rel_path")


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def path() -> F.Column:
    return F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def docs(spark, d) -> DataFrame:
    p = path()
    return t(spark, d, "documents").select(p.alias("doc_id"), p.alias("rel_path"), F.col("text").alias("body"), F.lit("").alias("summary"), X.estimate_tokens(F.col("text")).alias("token_estimate"))


def corpus(spark, d, fields=("body",)) -> Corpus:
    return Corpus.of(docs(spark, d), fields)


DOCS = "docs AS (SELECT lang || '/' || source || '/' || doc_id || '.md' AS doc_id, text AS body FROM documents)"
TOKENS = DOCS + r""", toks AS (SELECT doc_id, unnest(list_zip(range(len(l)), l), recursive := false) AS x FROM (SELECT doc_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS l FROM docs)),
occ AS (SELECT doc_id, CAST(x[1] AS INT) AS pos, x[2] AS term FROM toks WHERE octet_length(encode(x[2])) < 40),
len AS (SELECT d.doc_id, count(o.pos) AS dl FROM docs d LEFT JOIN occ o USING (doc_id) GROUP BY d.doc_id),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM len)"""


def bm25(hits: str, boost: float = 1.0) -> str:
    """SQL for (doc_id, score) of hits (doc_id, tf)."""
    return f"""SELECT h.doc_id, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * {boost}::DOUBLE AS score
FROM ({hits}) h JOIN len USING (doc_id), st, (SELECT CAST(count(*) AS DOUBLE) AS df FROM ({hits}))"""


def tf(term: str) -> str:
    return f"SELECT doc_id, CAST(count(*) AS DOUBLE) AS tf FROM occ WHERE term = '{term}' GROUP BY doc_id"


def phrase(words: list[str], slop: int = 0) -> str:
    joins = "".join(f" JOIN occ o{i} ON o{i}.doc_id = o0.doc_id AND o{i}.term = '{w}' AND o{i}.pos BETWEEN o0.pos + {i} AND o0.pos + {i + slop}" for i, w in enumerate(words) if i)
    return f"SELECT doc_id, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT DISTINCT o0.doc_id, o0.pos FROM occ o0{joins} WHERE o0.term = '{words[0]}') GROUP BY doc_id"


def top(scores: str, k: int = 20) -> str:
    return f"WITH {TOKENS}, s AS ({scores}) SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT {k})"


def summed(*parts: str) -> str:
    return "SELECT doc_id, sum(score) AS score FROM (" + " UNION ALL ".join(parts) + ") GROUP BY doc_id"


def searched(name: str, text: str, sql: str | None, fields=("body",), k: int = 20):
    def f(spark, d):
        return search(corpus(spark, d, fields), text, k, fields, with_docs=False).select("doc_id", F.round("score", 6).alias("score"))

    f.__name__ = name
    register(top(sql, k) if sql else None)(f)


searched("search_term", "idiot", bm25(tf("idiot")))
searched("search_or", "token license idiot", summed(bm25(tf("token")), bm25(tf("license")), bm25(tf("idiot"))))
searched("search_and", "license AND mit", f"SELECT a.doc_id, a.score + b.score AS score FROM ({bm25(tf('license'))}) a JOIN ({bm25(tf('mit'))}) b USING (doc_id)")
searched("search_not", "license -mit", f"SELECT * FROM ({bm25(tf('license'))}) WHERE doc_id NOT IN ({tf('mit').replace(', CAST(count(*) AS DOUBLE) AS tf', '')})")
searched("search_must", "+license token", f"SELECT a.doc_id, a.score + coalesce(b.score, 0) AS score FROM ({bm25(tf('license'))}) a LEFT JOIN ({bm25(tf('token'))}) b USING (doc_id)")
searched("search_parens", "(mit OR gnu) AND license", f"SELECT a.doc_id, a.score + b.score AS score FROM ({summed(bm25(tf('mit')), bm25(tf('gnu')))}) a JOIN ({bm25(tf('license'))}) b USING (doc_id)")
searched("search_phrase", '"mit license"', bm25(phrase(["mit", "license"])))
searched("search_compound_word", "MIT-License", bm25(phrase(["mit", "license"])))
searched("search_slop", '"under license"~3', bm25(phrase(["under", "license"], 3)))
searched("search_field_scoped", "body:license", bm25(tf("license")))
searched("search_boost", "license^2.5 token", summed(bm25(tf("license"), 2.5), bm25(tf("token"))))
searched("search_sanitized", "license ((", bm25(tf("license")))
searched("search_negative_only", "-license", bm25(tf("license")))
searched("search_match_all", "*", "SELECT doc_id, 1.0::DOUBLE AS score FROM docs")
searched("search_set", "body: IN [license token]", "SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM occ WHERE term IN ('license', 'token')")
searched("search_path_range", "rel_path:[de/ TO de/src2]", "SELECT doc_id, 1.0::DOUBLE AS score FROM docs WHERE doc_id >= 'de/' AND doc_id <= 'de/src2'", ("body", "rel_path"))


@register(f"WITH {TOKENS}, s AS ({bm25(tf('license'))}), k AS (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20) SELECT k.doc_id, round(score, 6) AS score, token_estimate FROM k JOIN (SELECT doc_id, CAST(len(regexp_extract_all(body, '\\S+')) AS BIGINT) AS token_estimate FROM docs) USING (doc_id) WHERE token_estimate <= 150")
def search_budget_post_limit(spark, d):
    return search(corpus(spark, d), "license", 20, ("body",), max_tokens=150).select("doc_id", F.round("score", 6).alias("score"), "token_estimate")


@register(f"WITH {TOKENS}, s AS ({bm25(tf('license'))}) SELECT doc_id, round(score, 6) AS score, '' AS snippet FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 20)")
def search_no_snippets(spark, d):
    return search(corpus(spark, d), "license", 20, ("body",)).select("doc_id", F.round("score", 6).alias("score"), F.lit("").alias("snippet"))


@register(f"WITH {DOCS} SELECT doc_id FROM docs ORDER BY doc_id LIMIT 50 OFFSET 100")
def docs_page(spark, d):
    return docs(spark, d).select("doc_id").orderBy("doc_id").offset(100).limit(50)


@register(f"WITH {DOCS} SELECT doc_id FROM docs WHERE false")
def docs_page_past_end(spark, d):
    return docs(spark, d).select("doc_id").orderBy("doc_id").offset(50_000_000).limit(50)


@register("SELECT count(*) AS total FROM documents")
def docs_total(spark, d):
    return docs(spark, d).agg(F.count("*").alias("total"))


@register(f"WITH {DOCS} SELECT doc_id, length(body) AS n FROM docs WHERE doc_id LIKE '%/7.md'")
def doc_lookup(spark, d):
    return docs(spark, d).where(F.col("doc_id").like("%/7.md")).select("doc_id", F.length("body").cast("long").alias("n"))


@register("SELECT 'no/such.md' AS wanted, CAST(NULL AS VARCHAR) AS doc_id")
def doc_lookup_missing(spark, d):
    one = spark.range(1).select(F.lit("no/such.md").alias("wanted"))
    return one.join(docs(spark, d).select("doc_id"), F.col("doc_id") == F.col("wanted"), "left")


@register(f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM occ GROUP BY term")
def term_stats(spark, d):
    return index.term_stats(docs(spark, d), ("body",)).select("term", "df", "cf")


@register(f"WITH {TOKENS} SELECT doc_id, dl FROM len")
def doc_len(spark, d):
    return index.doc_lengths(docs(spark, d), ("body",)).select("doc_id", "dl")


@register(f"WITH {TOKENS} SELECT count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_tokens, round(avg(dl), 6) AS avgdl FROM len")
def field_stats(spark, d):
    return index.field_stats(docs(spark, d), ("body",)).select("n_docs", "total_tokens", F.round("avgdl", 6).alias("avgdl"))


@register(r"WITH p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term, doc_id, count(*) AS tf FROM p WHERE octet_length(encode(term)) < 40 GROUP BY term, doc_id")
def postings(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    return index.term_counts(x, "body").select("term", "doc_id", "tf")


@register("SELECT count(*) AS num_docs, CAST(sum(octet_length(encode(text))) // count(*) AS BIGINT) AS avg_bytes_per_doc FROM documents")
def index_stats(spark, d):
    return t(spark, d, "documents").agg(F.count("*").alias("num_docs"), F.floor(F.sum(F.octet_length("text")) / F.count("*")).cast("long").alias("avg_bytes_per_doc"))


@register(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS token_estimate FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("token_estimate"))


@register(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def collapse_ws(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(X.collapse_whitespace(F.col("text"))).alias("digest"))


@register(r"SELECT doc_id, CASE WHEN length(text) <= 360 THEN text ELSE regexp_replace(text[1:359], '\s+$', '') || '…' END AS cut FROM documents")
def truncate_360(spark, d):
    return t(spark, d, "documents").select("doc_id", X.truncate_to_limit(F.col("text"), 360).alias("cut"))


LINES = r"""l AS (SELECT doc_id, unnest(list_zip(range(1, len(x) + 1), x), recursive := false) AS y FROM (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN a[1:len(a) - 1] ELSE a END AS x FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS a FROM documents))),
raw AS (SELECT doc_id, CAST(y[1] AS INT) AS n, y[2] AS line FROM l)"""


def prefix_sql(x: str) -> str:
    box, bullet = r"'^[-*+] \[[ xX]\]\s*'", r"'^[-*+]\s+'"
    return rf"CASE WHEN regexp_matches({x}, {box}) THEN regexp_replace({x}, {box}, '') WHEN regexp_matches({x}, {bullet}) THEN regexp_replace({x}, {bullet}, '') ELSE regexp_replace({x}, '^(?:\d+[.)])+\s*', '') END"


PLAIN = LINES + rf""", trimmed AS (SELECT doc_id, n, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^(?:>\s*)+', '') AS q FROM raw),
bare AS (SELECT doc_id, n, t, CASE WHEN starts_with(t, '#') THEN regexp_replace(t, '^#+\s*', '') ELSE {prefix_sql('q')} END AS b FROM trimmed),
plain AS (SELECT doc_id, n, t, nullif(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(b, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '<[^>]+>', '', 'g'), '`', ''), '\s+', ' ', 'g')), '') AS p FROM bare)"""


def text_lines(spark, d, of=None) -> DataFrame:
    """(doc_id, n, line), each line as `of` makes it: before the lines become rows, so that a filter on them doesn't work it out again."""
    ls = X.lines(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.posexplode(ls if of is None else F.transform(ls, of)).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("n"), "line")


@register(f"WITH {PLAIN} SELECT doc_id, n, p AS line FROM plain WHERE p IS NOT NULL")
def md_line_normalize(spark, d):
    return text_lines(spark, d, X.normalize_line).where("line is not null")


@register(r"SELECT doc_id, md5(regexp_replace(text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g')) AS digest FROM documents")
def md_link_strip(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(X.strip_links(F.col("text"))).alias("digest"))


@register("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def html_tag_strip(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("digest"))


@register(f"WITH {LINES} SELECT doc_id, n, {prefix_sql('line')} AS line FROM raw")
def list_prefix(spark, d):
    return text_lines(spark, d).select("doc_id", "n", X.strip_list_prefix(F.col("line")).alias("line"))


@register(r"SELECT doc_id, md5(regexp_replace(text, '^[\r\n]+', '')) AS digest FROM documents")
def front_matter_strip(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(X.strip_front_matter(F.concat(F.lit("---\ntitle: "), "source", F.lit("\n---\n"), "text"))).alias("digest"))


#: Segments (headings, paragraphs) of the texts; texts with front matter, of which there are none, aren't treated.
SEGMENTS = PLAIN + r""", fenced AS (SELECT *, regexp_matches(t, '^(```|~~~)') AS fence, count(*) FILTER (WHERE regexp_matches(t, '^(```|~~~)')) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM plain),
shown AS (SELECT *, starts_with(t, '#') AND p IS NOT NULL AS heading FROM fenced WHERE NOT fence AND fences % 2 = 0),
parts AS (SELECT *, count(*) FILTER (WHERE t = '' OR heading) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM shown),
seg AS (SELECT doc_id, heading, min(n) AS first, string_agg(p, ' ' ORDER BY n) AS s FROM parts WHERE p IS NOT NULL GROUP BY doc_id, part, heading),
four AS (SELECT *, row_number() OVER w AS i, first_value(heading) OVER w AS titled FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY first) QUALIFY i <= 4),
sep AS (SELECT *, CASE WHEN i = 1 THEN s WHEN i = 2 AND titled THEN ' — ' || s ELSE ' ' || s END AS piece FROM four),
upto AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS before FROM sep),
made AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS s FROM upto WHERE before < 360 GROUP BY doc_id),
whole AS (SELECT doc_id, coalesce(m.s, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS s FROM documents LEFT JOIN made m USING (doc_id))"""


@register(f"WITH {SEGMENTS} SELECT doc_id, CASE WHEN length(s) <= 360 THEN s ELSE regexp_replace(s[1:359], '\\s+$', '') || '…' END AS summary FROM whole")
def summary(spark, d):
    return t(spark, d, "documents").select("doc_id", X.summarize("text").alias("summary"))


def of_summaries(sql: str) -> str:
    """The same SQL over the tables made from the summaries."""
    for x in ("docs", "toks", "occ", "len", "st"):
        sql = re.sub(rf"\b{x}\b(?!\()", f"summary_{x}", sql)
    return sql


SUMMARY_TOKENS = TOKENS + ", " + SEGMENTS + r""", summary_docs AS (SELECT lang || '/' || source || '/' || documents.doc_id || '.md' AS doc_id, CASE WHEN length(s) <= 360 THEN s ELSE regexp_replace(s[1:359], '\s+$', '') || '…' END AS body FROM documents JOIN whole USING (doc_id)), """ + of_summaries(TOKENS[len(DOCS) + 2 :])


@register(f"WITH {SUMMARY_TOKENS}, s AS ({summed(*(f(bm25(tf(w))) for f in (str, of_summaries) for w in ('license', 'token')))}) SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20)")
def search_multi_field(spark, d):
    x = docs(spark, d).withColumn("summary", X.summarize("body"))
    return search(Corpus.of(x), "license token", 20, with_docs=False).select("doc_id", F.round("score", 6).alias("score"))


@register(LINES.join(["WITH ", r""", few AS (SELECT doc_id, trim(regexp_replace(string_agg(regexp_replace(line, '^\s+|\s+$', '', 'g'), ' ' ORDER BY n), '\s+', ' ', 'g')) AS x FROM raw WHERE n <= 60 AND regexp_matches(line, '\S') GROUP BY doc_id),
sentences AS (SELECT doc_id, unnest(list_zip(range(len(y)), y), recursive := false) AS z FROM (SELECT doc_id, regexp_split_to_array(x, '[.!?]+\s+') AS y FROM few)),
placed AS (SELECT doc_id, z[1] AS i, z[2] AS s, sum(length(z[2]) + 1) OVER (PARTITION BY doc_id ORDER BY z[1]) - length(z[2]) - 2 AS before FROM sentences),
joined AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS s FROM placed WHERE before < 420 GROUP BY doc_id),
every AS (SELECT lang || '/' || source || '/' || documents.doc_id || '.md' AS doc_id, coalesce(s, '') AS s FROM documents LEFT JOIN joined USING (doc_id))
SELECT doc_id, CASE WHEN length(s) <= 420 THEN s ELSE regexp_replace(s[1:419], '\s+$', '') || '…' END AS preview FROM every"""]))
def condense_preview(spark, d):
    return docs(spark, d).select("doc_id", preview(F.col("body")).alias("preview"))


@register(f"WITH {LINES}, third AS (SELECT * FROM raw WHERE n = 3 AND line <> ''), place AS (SELECT doc_id, left(text, strpos(text, line) - 1) AS upto FROM documents JOIN third USING (doc_id)), spot AS (SELECT doc_id, length(upto) - length(replace(upto, chr(10), '')) + 1 AS k FROM place) SELECT doc_id, CAST(coalesce(k, 0) AS INT) AS line_start, CAST(coalesce(k, 0) AS INT) AS line_end FROM documents LEFT JOIN spot USING (doc_id)")
def line_range(spark, d):
    return t(spark, d, "documents").select("doc_id", X.line_range(F.col("text"), F.get(X.lines(F.col("text")), F.lit(2))).alias("r")).select("doc_id", *(F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in ("line_start", "line_end")))


@register(r"SELECT doc_id, array_to_string(list_slice(CASE WHEN ends_with(text, chr(10)) THEN l[1:len(l) - 1] ELSE l END, 2, 3), chr(10)) AS part FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS l FROM documents)")
def line_slice(spark, d):
    return t(spark, d, "documents").select("doc_id", X.line_slice(F.col("text"), 2, 3).alias("part"))


PATHS = "concat(CASE doc_id % 5 WHEN 0 THEN 'Vendor/' WHEN 1 THEN 'secret/' WHEN 2 THEN 'secrets/' ELSE 'docs/' END, source, CASE doc_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.txt' ELSE '.rs' END)"


@register(f"SELECT doc_id, p AS rel_path FROM (SELECT doc_id, {PATHS} AS p FROM documents) WHERE NOT starts_with(lower(p), 'vendor/') AND NOT starts_with(p, 'secret/') AND NOT ends_with(p, '.rs')")
def path_filter(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.expr(PATHS).alias("rel_path"))
    return x.where(path_wanted(F.col("rel_path"), Config.of(prefixes=["secret"])))


@register(f"""WITH {TOKENS}, s AS (SELECT 'token' AS term, doc_id, score FROM ({bm25(tf('token'))}) UNION ALL SELECT 'license', doc_id, score FROM ({bm25(tf('license'))})),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(score, 9) DESC, doc_id) AS k FROM s) SELECT term, doc_id, k FROM r WHERE k <= 6""")
def self_check(spark, d):
    c = corpus(spark, d)
    out = None
    for word in ("token", "license"):
        part = matches(c, query.understand(word, ("body",))).withColumn("term", F.lit(word))
        out = part if out is None else out.unionByName(part)
    k = F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return out.withColumn("k", k.cast("long")).where("k <= 6").select("term", "doc_id", "k")


VERSIONS = "SELECT doc_id, source AS body, CAST(1 AS BIGINT) AS seq, false AS deleted FROM documents UNION ALL SELECT doc_id, lang, CAST(2 AS BIGINT), doc_id % 7 = 0 FROM documents WHERE doc_id % 2 = 0"


@register(f"SELECT doc_id, body, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS k FROM ({VERSIONS})) WHERE k = 1 AND NOT deleted")
def upsert_resolve(spark, d):
    return resolve(spark.sql(VERSIONS.replace("FROM documents", "FROM {x}"), x=t(spark, d, "documents"))).select("doc_id", "body", "seq")


@register("SELECT doc_id FROM documents WHERE doc_id % 14 = 0")
def delete_resolve(spark, d):
    live = resolve(spark.sql(VERSIONS.replace("FROM documents", "FROM {x}"), x=t(spark, d, "documents")))
    return t(spark, d, "documents").join(live.select("doc_id"), "doc_id", "left_anti").select("doc_id")


@register("""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1e6::DOUBLE AS s FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM e),
b AS (SELECT event_id, user_id, s, k, 2.0::DOUBLE AS held FROM o WHERE k = 1
UNION ALL SELECT o.event_id, o.user_id, o.s, o.k, least(2.0::DOUBLE, CASE WHEN b.held >= 1 THEN b.held - 1.0::DOUBLE ELSE b.held END + (o.s - b.s) * (2.0::DOUBLE / 60.0::DOUBLE)) FROM b JOIN o ON o.user_id = b.user_id AND o.k = b.k + 1)
SELECT event_id, user_id, held >= 1 AS allowed FROM b""")
def rate_limit(spark, d):
    e = t(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6)
    return rate_limited(e, "user_id", "s", "event_id", 2, 2).select("event_id", "user_id", "allowed")


@register("""WITH h AS (SELECT event_id, user_id, sha256(CAST(CASE WHEN event_id % 7 = 2 THEN -event_id ELSE event_id END AS VARCHAR)) AS hash, sha256(CAST(event_id AS VARCHAR)) AS own FROM events),
p AS (SELECT *, lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM h)
SELECT event_id, (CASE WHEN event_id % 10 = 3 THEN 'x' ELSE before END) IS NOT DISTINCT FROM before AND hash = own AS linked FROM p""")
def audit_verify(spark, d):
    """One in ten records with a wrong link, one in seven whose content isn't what its hash says."""
    said = F.when(F.col("event_id") % 7 == 2, -F.col("event_id")).otherwise(F.col("event_id"))
    h = t(spark, d, "events").select("event_id", "user_id", F.sha2(said.cast("string"), 256).alias("hash"))
    before = F.lag("hash").over(Window.partitionBy("user_id").orderBy("event_id"))
    h = h.withColumn("prev_hash", F.when(F.col("event_id") % 10 == 3, F.lit("x")).otherwise(before))
    return verify(h, "user_id", "event_id", F.col("event_id").cast("string")).select("event_id", "linked")


ESCAPED = "replace(replace(replace(replace(run, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@register(rf"""WITH RECURSIVE {TOKENS}, s AS ({summed(bm25(tf('license')), bm25(tf('token')))}), best AS (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 20),
w AS (SELECT term, 1.0::DOUBLE / (1 + count(DISTINCT doc_id)) AS weight FROM occ WHERE term IN ('license', 'token') GROUP BY term),
runs AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS run FROM (SELECT doc_id, regexp_extract_all(body, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS l FROM docs JOIN best USING (doc_id))),
r AS (SELECT doc_id, k, run, octet_length(encode(run)) AS n, regexp_matches(run, '^[\p{{L}}\p{{N}}]') AS word, coalesce(weight, 0.0::DOUBLE) AS weight FROM runs LEFT JOIN w ON term = lower(run)),
deal AS (SELECT doc_id, k, CAST(0 AS BIGINT) AS frag, n AS used FROM r WHERE k = 1
UNION ALL SELECT r.doc_id, r.k, CASE WHEN d.used + r.n > {X.SNIPPET_CHARS} AND r.word THEN d.frag + 1 ELSE d.frag END, CASE WHEN d.used + r.n > {X.SNIPPET_CHARS} AND r.word THEN r.n ELSE d.used + r.n END FROM deal d JOIN r ON r.doc_id = d.doc_id AND r.k = d.k + 1),
per AS (SELECT doc_id, frag, round(sum(weight), 12) AS score, max(k) FILTER (WHERE word) AS upto FROM deal JOIN r USING (doc_id, k) GROUP BY doc_id, frag),
pick AS (SELECT doc_id, frag, upto FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, frag) AS place FROM per WHERE score > 0) WHERE place = 1)
SELECT doc_id, regexp_replace(string_agg(run, '' ORDER BY k), '^\s+', '') AS snippet, regexp_replace(string_agg(CASE WHEN weight > 0 THEN '<b>' || {ESCAPED} || '</b>' ELSE {ESCAPED} END, '' ORDER BY k), '^\s+', '') AS html
FROM deal JOIN r USING (doc_id, k) JOIN pick USING (doc_id, frag) WHERE k <= upto GROUP BY doc_id""")
def snippet_best_fragment(spark, d):
    c = corpus(spark, d)
    hits = search(c, "license token", 20, ("body",))
    words = ["license", "token"]
    df = c.frequencies("body", words)
    return best_fragments(hits.select("doc_id", "body"), {w: df.get(w, 0) for w in words})


RULES = r"""rule AS (SELECT item_id || '/' || i AS query, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c, l[i + 4] AS d, l[i + 5] AS e FROM (SELECT item_id, l, unnest(range(1, len(l) - 4)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM benchmark)))"""


@register(f"""WITH {TOKENS}, {RULES}, has AS (SELECT DISTINCT doc_id, term FROM occ),
pair AS (SELECT DISTINCT query, x.doc_id FROM rule JOIN occ x ON x.term = b JOIN occ y ON y.term = c AND y.doc_id = x.doc_id AND y.pos = x.pos + 1),
either AS (SELECT query, doc_id FROM pair UNION SELECT query, doc_id FROM rule JOIN has ON term = d),
fit AS (SELECT query, h.doc_id FROM either JOIN rule USING (query) JOIN has h ON h.term = a AND h.doc_id = either.doc_id)
SELECT f.query, count(*) AS n, min(f.doc_id) AS first_doc, max(f.doc_id) AS last_doc FROM fit f JOIN rule USING (query) LEFT JOIN has h ON h.term = e AND h.doc_id = f.doc_id WHERE h.doc_id IS NULL GROUP BY f.query""")
def percolation(spark, d):
    """A query for each place of the benchmark's texts, +word +("two words" OR word) -word, over all documents."""
    words = t(spark, d, "benchmark").select("item_id", index.tokens(F.col("text")).alias("l"))
    rule = words.where(F.size("l") > 5).select("item_id", "l", F.explode(F.sequence(F.lit(1), F.size("l") - 5)).alias("i"))
    w = lambda k: F.get("l", F.col("i") + (k - 1))
    asked = rule.select(F.concat_ws("/", "item_id", "i").alias("query"), F.concat(F.lit("+"), w(0), F.lit(' +("'), w(1), F.lit(" "), w(2), F.lit('" OR '), w(4), F.lit(") -"), w(5)).alias("text"))
    part = fits(corpus(spark, d), trees(asked, ("body",))).select("query", F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("first_doc"), F.array_max("ids").alias("last_doc"))
    return part.groupBy("query").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))


_stored: dict[tuple, Store] = {}


def stored(spark, d) -> Store:
    """An index of the documents, built once a session: first all rows with other bodies for some and some that don't belong, then an update that puts both right."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = Path(tempfile.mkdtemp(prefix="quillspark-")).as_uri()
        store = Store(spark, f"{base.rstrip('/')}/quillspark-index-{uuid.uuid4().hex[:12]}")
        own = docs(spark, d).withColumns({"body": F.coalesce("body", F.lit("")), "token_estimate": F.coalesce("token_estimate", F.lit(0).cast("long"))})
        late = F.pmod(F.xxhash64("doc_id"), F.lit(20)) == 0
        wrong = own.where(late)
        ghosts = wrong.withColumns({"doc_id": F.concat("doc_id", F.lit(".old")), "rel_path": F.concat("rel_path", F.lit(".old"))})
        store.write(own.where(~late).unionByName(wrong.withColumn("body", F.lit("license token to be replaced"))).unionByName(ghosts))
        store.change(wrong, ghosts)
        _stored[key] = store
    return _stored[key]


def stored_search(name: str, text: str, sql: str, k: int = 20):
    """The same words as in a search above, asked of the stored segments: the filter on terms reaches their files."""

    def f(spark, d):
        return search(stored(spark, d).corpus(), text, k, ("body",), with_docs=False).select("doc_id", F.round("score", 6).alias("score"))

    f.__name__ = name
    register(top(sql, k))(f)


stored_search("stored_search_term", "idiot", bm25(tf("idiot")))
stored_search("stored_search_or", "token license idiot", summed(bm25(tf("token")), bm25(tf("license")), bm25(tf("idiot"))))
stored_search("stored_search_phrase", '"mit license"', bm25(phrase(["mit", "license"])))


@register(f"WITH {TOKENS} SELECT count(*) AS num_docs, CAST(sum(dl) AS BIGINT) AS total_tokens, count(*) AS manifest_docs, CAST(sum(dl) AS BIGINT) AS manifest_tokens FROM len")
def stored_stats(spark, d):
    """What the segments' tables hold, beside what the manifest says, which the update has kept right."""
    c = stored(spark, d).corpus()
    held = c.docs.agg(F.count("*").alias("num_docs")).join(c.terms.where("field = 'body'").agg(F.sum("cf").alias("total_tokens")))
    return held.join(c.stats.where("field = 'body'").select(F.col("n_docs").alias("manifest_docs"), F.col("total_tokens").alias("manifest_tokens")))


@register(f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM occ GROUP BY term")
def stored_dictionary(spark, d):
    """Counts of each word over the segments, what the update replaced taken off."""
    return stored(spark, d).corpus().terms.where("field = 'body'").select("term", "df", "cf")


@register(f"WITH {TOKENS}, c AS (SELECT DISTINCT doc_id FROM occ WHERE term >= 'lic' AND term < 'lid') SELECT doc_id, 1.0::DOUBLE AS score FROM c")
def stored_range(spark, d):
    return matches(stored(spark, d).corpus(), query.Range("body", "lic", "lid", True, False))


@register(f"WITH {TOKENS}, most AS (SELECT doc_id, pos, term, dl FROM occ JOIN len USING (doc_id) WHERE term IN ('the', 'license')), per AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM most GROUP BY doc_id, term) SELECT term, CAST(sum(tf) AS BIGINT) AS tf, CAST(max(tf) AS INT) AS most, min(dl) AS shortest, count(*) AS n FROM per GROUP BY term")
def stored_blocks(spark, d):
    """From the blocks of the stored segments: entries of two words, the largest tf and the least dl of each."""
    c = stored(spark, d).corpus()
    b = c.live(c.blocks.where("field = 'body' and term in ('the', 'license')").select("seg", "term", F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl")))))
    return b.groupBy("term").agg(F.sum("tf").alias("tf"), F.max("tf").alias("most"), F.min("dl").alias("shortest"), F.count("*").alias("n"))


@register(f"WITH {DOCS} SELECT doc_id, length(body) AS n FROM docs ORDER BY doc_id LIMIT 50 OFFSET 100")
def stored_page(spark, d):
    return stored(spark, d).page(100, 50).select("doc_id", F.length("body").alias("n"))
