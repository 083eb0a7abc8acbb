"""Queries over documents: term statistics, cosine, k-grams, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import filters, lexical, shingle
from quillmesh.operators.graph import written
from quillmesh.plans.registry import query, read
from quillmesh.sources import parse

_T = r"""t AS (SELECT doc_id, lower(w) AS term, count(*) AS ct FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT doc_id, term, ct / (1.0 + sum(ct) OVER (PARTITION BY doc_id)) * ln((SELECT count(DISTINCT doc_id) FROM t) / (1.0 + df)) AS score FROM t JOIN f USING (term)),
u AS (SELECT doc_id, term, CASE WHEN n > 0 THEN score / n ELSE score END AS score FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY doc_id)) AS n FROM s)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS rank FROM u),
v AS (SELECT doc_id, term, CASE WHEN n > 0 THEN score / n ELSE score END AS score FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY doc_id)) AS n FROM r WHERE rank <= 10))"""


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def r6_pairs(c):
    """r6 without a decimal for each row, half away from zero: for billions of rows."""
    x = F.col(c)
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6 + F.lit(0.0)


def _counts(spark, d):
    return lexical.counts(lexical.terms(read(spark, d, "documents")))


def _words():
    """Lower-cased words as terms, for packed_vectors."""
    return F.transform(T.words(F.col("text")), lambda w: F.lower(w)), 0, ""


def _vectors(spark, d):
    return lexical.limited(lexical.unit(lexical.tf_idf(_counts(spark, d))), 10)


@query(f"WITH {_T.split('),' + chr(10))[0]}) SELECT doc_id, term, ct FROM t")
def term_counts(spark, d):
    return _counts(spark, d)


@query(f"WITH {_T} SELECT term, df FROM f")
def doc_freq(spark, d):
    return lexical.document_frequency(_counts(spark, d))


@query(r"""WITH k AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM benchmark) WHERE length(w) >= 3),
w AS (SELECT doc_id, w, count(*) AS ct FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents) GROUP BY ALL),
whole AS (SELECT doc_id, lower(w) AS term, ct FROM w WHERE lower(w) IN (SELECT word FROM k)),
parts AS (SELECT doc_id, unnest(string_split(lower(regexp_replace(w, '(\p{Ll})(\p{Lu})', '\1 \2', 'g')), ' ')) AS term, ct FROM w WHERE lower(w) NOT IN (SELECT word FROM k) AND regexp_matches(w, '\p{Ll}\p{Lu}'))
SELECT doc_id, term, CAST(sum(ct) AS BIGINT) AS ct FROM (SELECT * FROM whole UNION ALL SELECT * FROM parts WHERE term IN (SELECT word FROM k)) GROUP BY ALL""")
def dict_terms(spark, d):
    lines = read(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w"))
    return lexical.dictionary_terms(read(spark, d, "documents"), parse.dictionary(lines, "w"))


@query(f"WITH {_T} SELECT doc_id, term, round(score, 6) + 0.0 AS score FROM s")
def tfidf(spark, d):
    return lexical.tf_idf(_counts(spark, d)).withColumn("score", r6("score"))


@query(f"WITH {_T} SELECT doc_id, term, round(score, 6) + 0.0 AS score FROM u")
def tfidf_unit(spark, d):
    return lexical.unit(lexical.tf_idf(_counts(spark, d))).withColumn("score", r6("score"))


@query(f"WITH {_T} SELECT doc_id, term, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 6")
def top_terms(spark, d):
    return lexical.top_terms(lexical.unit(lexical.tf_idf(_counts(spark, d)))).withColumn("score", r6("score"))


@query(f"WITH {_T} SELECT doc_id, term, round(score, 6) + 0.0 AS score FROM v")
def top10_renorm(spark, d):
    return _vectors(spark, d).withColumn("score", r6("score"))


@query(f"WITH {_T} SELECT doc_id, array_to_string(list(term ORDER BY rank), ' ') AS words FROM r WHERE rank <= 6 GROUP BY doc_id")
def suggested_words(spark, d):
    top = lexical.top_terms(lexical.unit(lexical.tf_idf(_counts(spark, d))))
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("words"))


@query(f"WITH {_T}, p AS (SELECT a.doc_id, b.doc_id AS other_id, sum(a.score * b.score) AS score FROM v a JOIN v b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL) SELECT doc_id, other_id, round(score, 6) + 0.0 AS score FROM p WHERE round(score, 9) >= 0.4")
def cosine_pairs(spark, d):
    v = lexical.packed_vectors(read(spark, d, "documents"), [_words()])
    return lexical.near_pairs(v, 0.4, "doc_id", "other_id").withColumn("score", r6_pairs("score"))


@query(f"WITH {_T}, p AS (SELECT a.doc_id AS rep, b.doc_id AS item, sum(a.score * b.score) AS score FROM v a JOIN v b ON a.term = b.term AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY ALL HAVING round(sum(a.score * b.score), 9) >= 0.4) SELECT rep, item, round(score, 6) + 0.0 AS score FROM p QUALIFY row_number() OVER (PARTITION BY rep, round(score, 6) ORDER BY item) = 1")
def text_matches(spark, d):
    v = _vectors(spark, d)
    reps = v.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "rep")  # each representative against all results
    return lexical.text_matches(reps, v.withColumnRenamed("doc_id", "item"), 0.4, collapse=True).withColumn("score", r6("score"))


@query(rf"""WITH {_T},
bt AS (SELECT item_id, lower(w) AS term, count(*) AS ct FROM (SELECT item_id, unnest(regexp_extract_all(text, '\p{{L}}+')) AS w FROM benchmark) GROUP BY ALL),
bs AS (SELECT item_id, term, ct / (1.0 + sum(ct) OVER (PARTITION BY item_id)) * ln((SELECT count(DISTINCT doc_id) FROM t) / (1.0 + coalesce(df, 0))) AS score FROM bt LEFT JOIN f USING (term)),
bu AS (SELECT item_id, term, CASE WHEN n > 0 THEN score / n ELSE score END AS score FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY item_id)) AS n FROM bs)),
br AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, term) AS rank FROM bu),
bv AS (SELECT item_id, term, CASE WHEN n > 0 THEN score / n ELSE score END AS score FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY item_id)) AS n FROM br WHERE rank <= 10))
SELECT v.doc_id, bv.item_id, round(sum(v.score * bv.score), 6) + 0.0 AS score FROM v JOIN bv USING (term) GROUP BY ALL HAVING round(sum(v.score * bv.score), 9) >= 0.4""")
def contamination(spark, d):
    c = written(_counts(spark, d))
    df, n = lexical.document_frequency(c), c.select("doc_id").distinct().count()
    items = lexical.counts(lexical.terms(read(spark, d, "benchmark"), "item_id"), "item_id")
    b = lexical.limited(lexical.unit(lexical.tf_idf(items, "item_id", df, n), "item_id"), 10, "item_id")
    v = lexical.limited(lexical.unit(lexical.tf_idf(c, df=df, n=n)), 10)
    return lexical.cosine(v, b, 0.4, "doc_id", "item_id").withColumn("score", r6("score"))


# words as tokens, a full stop as the delimiter
def _tokens():
    return F.regexp_extract_all(F.lower("text"), F.lit(r"\p{IsAlphabetic}+|\."), F.lit(0))


_G = r"""tok AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+|\.') AS w FROM documents)),
seg AS (SELECT *, sum(CASE WHEN token = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS sg FROM tok),
w AS (SELECT doc_id, sg, token, count(*) OVER (PARTITION BY doc_id, sg) AS n, row_number() OVER (PARTITION BY doc_id, sg ORDER BY p) AS i, p FROM seg WHERE token <> '.'),
g AS (SELECT doc_id, p, i, n, string_agg(token, '') OVER (PARTITION BY doc_id, sg ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM w),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos, gram FROM g WHERE i = 1 OR i <= n - 4)"""


@query(f"WITH {_G} SELECT doc_id, pos, gram FROM k")
def kgrams(spark, d):
    g = shingle.segmented_grams(read(spark, d, "documents"), _tokens(), delimiters=(".",))
    return g.withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_G} SELECT gram, count(DISTINCT doc_id) AS df FROM k GROUP BY gram")
def kgram_df(spark, d):
    g = shingle.segmented_grams(read(spark, d, "documents"), _tokens(), delimiters=(".",))
    return lexical.document_frequency(g.groupBy("doc_id", F.col("gram").alias("term")).agg(F.count("*").alias("ct"))).withColumnRenamed("term", "gram")


_KG = f"""{_G}, gt AS (SELECT doc_id, gram AS term, count(*) AS ct FROM k GROUP BY ALL), gf AS (SELECT term, count(*) AS df FROM gt GROUP BY term),
gs AS (SELECT doc_id, term, ct / (1.0 + sum(ct) OVER (PARTITION BY doc_id)) * ln((SELECT count(DISTINCT doc_id) FROM gt) / (1.0 + df)) AS score FROM gt JOIN gf USING (term)),
gu AS (SELECT doc_id, term, CASE WHEN n > 0 THEN score / n ELSE score END AS score FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY doc_id)) AS n FROM gs)),
gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS rank FROM gu),
gv AS (SELECT doc_id, term, CASE WHEN n > 0 THEN score / n ELSE score END AS score FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY doc_id)) AS n FROM gr WHERE rank <= 10))"""


@query(f"""WITH {_T}, {_KG},
a AS (SELECT a.doc_id, b.doc_id AS other_id, sum(a.score * b.score) AS w FROM v a JOIN v b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING round(sum(a.score * b.score), 9) >= 0.5),
c AS (SELECT a.doc_id, b.doc_id AS other_id, sum(a.score * b.score) AS g FROM gv a JOIN gv b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING round(sum(a.score * b.score), 9) >= 0.2)
, p AS (SELECT doc_id, other_id FROM a UNION SELECT doc_id, other_id FROM c),
pw AS (SELECT p.doc_id, p.other_id, sum(x.score * y.score) AS w FROM p JOIN v x ON x.doc_id = p.doc_id JOIN v y ON y.doc_id = p.other_id AND y.term = x.term GROUP BY ALL),
pg AS (SELECT p.doc_id, p.other_id, sum(x.score * y.score) AS g FROM p JOIN gv x ON x.doc_id = p.doc_id JOIN gv y ON y.doc_id = p.other_id AND y.term = x.term GROUP BY ALL)
SELECT doc_id, other_id, round(CASE WHEN doc_id IN (SELECT doc_id FROM v) AND other_id IN (SELECT doc_id FROM v) THEN least(1.0, coalesce(w, 0) / 0.6 + coalesce(g, 0) / 0.25) ELSE 1.0 END, 6) + 0.0 AS score FROM p LEFT JOIN pw USING (doc_id, other_id) LEFT JOIN pg USING (doc_id, other_id)""")
def blended_score(spark, d):
    """Pairs whose words reach 0.5 or whose k-grams reach 0.2, with both true scores."""
    v = lexical.packed_vectors(read(spark, d, "documents"), [_words(), (_tokens(), shingle.K, ".")])
    return lexical.near_word_pairs(v, 0.5, 0.2, "doc_id", "other_id").withColumn("score", r6_pairs("score"))


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def digest_dedup(spark, d):
    return filters.first_per_digest(read(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("digest", "doc_id", "copies")


@query(r"""WITH l AS (SELECT doc_id, CAST(p AS BIGINT) AS pos, trim(ln) AS ln FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents) WHERE trim(ln) <> ''),
m AS (SELECT *, starts_with(ln, 'The') AS opens, NOT starts_with(ln, 'The') AND length(ln) < 20 AS shuts FROM l),
s AS (SELECT *, last_value(CASE WHEN opens THEN true WHEN shuts THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM m)
SELECT doc_id, pos FROM s WHERE coalesce(inside, false) AND NOT opens""")
def section_lines(spark, d):
    """The state machine of build scripts over the lines of documents: 'The' opens, a line under 20 characters shuts."""
    from pyspark.sql import Window

    t = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "ln")).withColumn("ln", F.trim("ln")).filter("ln <> ''")
    opens, shuts = F.col("ln").startswith("The"), ~F.col("ln").startswith("The") & (F.length("ln") < 20)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(F.when(opens, True).when(shuts, False), ignorenulls=True).over(w), F.lit(False))
    return t.withColumn("inside", state).filter(F.col("inside") & ~opens).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
n AS (SELECT DISTINCT host AS name FROM p),
k AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), 1, 2), '.') AS key FROM p),
e AS (SELECT name, unnest(list_transform(range(CAST(greatest(len(string_split(name, '.')) - 1, 1) AS BIGINT)), lambda x: array_to_string(list_slice(string_split(name, '.'), 1, CAST(len(string_split(name, '.')) - x AS BIGINT)), '.'))) AS key FROM n)
SELECT name, arg_max(key, length(key)) AS key FROM e JOIN k USING (key) GROUP BY name""")
def prefix_relax(spark, d):
    from quillmesh.operators import graph

    host = read(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("name")).distinct()
    known = host.select(F.array_join(F.slice(F.split("name", r"\."), 1, 2), ".").alias("key"))
    return graph.relaxed(host, known)


@query(r"""WITH p AS (SELECT page_id, url, lag(url) OVER (ORDER BY page_id) AS prev FROM pages)
SELECT page_id, CAST(coalesce((SELECT min(i) - 1 FROM range(1, least(length(url), length(prev)) + 1) t(i) WHERE url[i] <> prev[i]), least(length(url), length(prev))) AS INTEGER) AS lcp FROM p WHERE prev IS NOT NULL""")
def lcp(spark, d):
    # neighbours by page_id without a global window: ids are joined to their successors by rank within ranges
    from pyspark.sql import Window

    p = read(spark, d, "pages").select("page_id", "url")
    top = p.agg(F.max("page_id")).first()[0] or 0
    width = max(1, -(-(top + 1) // 64))
    b = p.withColumn("b", F.floor(F.col("page_id") / width)).withColumn("prev", F.lag("url").over(Window.partitionBy("b").orderBy("page_id")))
    lasts = b.groupBy("b").agg(F.max_by("url", "page_id").alias("last"))
    nearest = Window.orderBy("b")  # 64 rows at most
    lasts = lasts.select("b", F.lag("last").over(nearest).alias("before"))
    x = b.join(F.broadcast(lasts), "b").withColumn("prev", F.coalesce("prev", "before")).filter("prev IS NOT NULL")
    return x.select("page_id", T.common_prefix(F.col("url"), F.col("prev")).alias("lcp"))
