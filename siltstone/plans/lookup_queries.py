"""Queries of the logical joins: alignment, retrieval, containment, lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.text import snippet_paragraph
from siltstone.operators import retrieval as R
from siltstone.operators.cumulative import running_total
from siltstone.plans import views as V
from siltstone.plans.book import Book
from siltstone.session import table

book = Book()
S = f"WITH {V.SAMPLES}"
c = F.col


@book.add("J01_positional_alignment", "SELECT item_id, dataset_path, row_number() OVER (PARTITION BY dataset_path ORDER BY item_id) - 1 AS pos FROM eval_items")
def j01(spark, d):
    """Positions by key from running counts, so a set may hold any share of the rows."""
    rows = running_total(table(spark, d, "eval_items").select("item_id", "dataset_path").withColumn("one", F.lit(1).cast("bigint")), ["dataset_path"], ["item_id"], "one")
    return rows.select("item_id", "dataset_path", (c("_cum") - 1).alias("pos"))


@book.add("J02_document_lookup", "SELECT d.doc_id, d.title FROM documents d JOIN eval_items e ON d.doc_id = e.item_id - 9000")
def j02(spark, d):
    ids = table(spark, d, "eval_items").select((c("item_id") - 9000).alias("doc_id"))
    return table(spark, d, "documents").join(ids, "doc_id").select("doc_id", "title")


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@book.add(
    "J03_dense_top_k",
    f"WITH n AS (SELECT vec_id, embedding AS e, sqrt({DOT.format(a='embedding', b='embedding')}) AS n FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, {DOT.format(a='q.e', b='v.e')} / (q.n * v.n) AS score FROM n q, n v WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM s) SELECT query_id, hit_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5",
)
def j03(spark, d):
    """The stated query set (ids divisible by 100) against all vectors."""
    e = table(spark, d, "embeddings")
    out = R.dense_top_k(e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 5, "vec_id", "query_id", "embedding")
    return out.withColumn("score", F.round("score", 6))


TERMS = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


@book.add(
    "J04_bm25_top_k",
    f"""WITH d AS (SELECT doc_id, {TERMS.format(x='text')} AS t FROM documents WHERE text IS NOT NULL), sh AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT DISTINCT item_id, unnest({TERMS.format(x='item_prompt')}) AS term FROM eval_items WHERE item_id % 100 = 0),
p AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d), f AS (SELECT doc_id, len, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
w AS (SELECT f.term, f.doc_id, ln(1 + (sh.n - df.df + 0.5) / (df.df + 0.5)) * f.tf * 1.9 / (f.tf + 0.9 * (0.6 + 0.4 * f.len / sh.a)) AS w FROM f JOIN df USING (term), sh),
s AS (SELECT q.item_id AS query_id, w.doc_id AS hit_id, sum(w.w) AS score FROM w JOIN q USING (term) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, hit_id) AS rank FROM s)
SELECT query_id, hit_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""",
)
def j04(spark, d):
    """The stated query set (ids divisible by 100) against all documents."""
    queries = table(spark, d, "eval_items").where("item_id % 100 = 0").select(c("item_id").alias("query_id"), c("item_prompt").alias("text"))
    return R.bm25_top_k(table(spark, d, "documents"), queries, 5, "doc_id", "query_id", "text").withColumn("score", F.round("score", 5))


@book.add("J12_containment", "SELECT e.item_id, count(d.doc_id) AS n FROM eval_items e LEFT JOIN documents d ON contains(d.text, e.item_prompt) GROUP BY e.item_id")
def j12(spark, d):
    """Which whole item prompts stand in documents, in one automaton pass."""
    items = table(spark, d, "eval_items").select("item_id", "item_prompt")
    hits = R.containment_counts(table(spark, d, "documents"), items, "text", "item_prompt")
    return items.join(hits, items["item_prompt"] == hits["item"], "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


@book.add("J13_first_containing", "WITH s AS (SELECT group_index, sample_index, max(response) AS r, max(label) AS l FROM samples WHERE group_index IS NOT NULL GROUP BY ALL) SELECT group_index, min(CASE WHEN contains(r, l) THEN sample_index END) AS first FROM s GROUP BY group_index")
def j13(spark, d):
    s = table(spark, d, "samples").where("group_index IS NOT NULL").groupBy("group_index", "sample_index").agg(F.max("response").alias("r"), F.max("label").alias("l"))
    return s.groupBy("group_index").agg(F.min(F.when(F.contains("r", "l"), c("sample_index"))).alias("first"))


@book.add("J15_values_by_position", f"{S} SELECT a.sample_index, a.reward, b.value FROM s a JOIN events b ON a.sample_index = b.event_id")
def j15(spark, d):
    values = table(spark, d, "events").select(c("event_id").alias("sample_index"), "value")
    return V.samples(spark, d).select("sample_index", "reward").join(values, "sample_index")


@book.add("J16_partition_gather", f"{S} SELECT sample_index, sample_index % 4 AS rank, response_length FROM s")
def j16(spark, d):
    ranks = table(spark, d, "events").select(c("event_id").alias("sample_index"), F.pmod("event_id", F.lit(4)).alias("rank"))
    return V.samples(spark, d).select("sample_index", "response_length").join(ranks, "sample_index")


@book.add("J17_label_fallback", "SELECT sample_index, coalesce(label, json_extract_string(metadata, '$.rm_type')) AS value FROM samples")
def j17(spark, d):
    return table(spark, d, "samples").select("sample_index", F.coalesce(c("label"), F.get_json_object("metadata", "$.rm_type")).alias("value"))


@book.add(
    "J18_snippet_paragraph",
    "WITH x AS (SELECT doc_id, text, substr(replace(text, chr(10), ' '), CAST(greatest(length(text) // 2, 1) AS BIGINT), 20) AS sn FROM documents), y AS (SELECT *, strpos(replace(text, chr(10), ' '), sn) AS pos FROM x) SELECT doc_id, CASE WHEN pos > 0 AND length(sn) > 0 THEN regexp_replace(string_split(left(text, pos), chr(10))[-1] || substr(text, pos + 1, length(sn) - 1) || string_split(substr(text, pos + length(sn)), chr(10))[1], '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') END AS paragraph FROM y",
)
def j18(spark, d):
    """The paragraph around the snippet from the middle of each text."""
    docs = table(spark, d, "documents")
    sn = F.substring(F.replace(c("text"), F.lit("\n"), F.lit(" ")), F.greatest(F.call_function("div", F.length("text"), F.lit(2)).cast("int"), F.lit(1)), F.lit(20))
    return docs.select("doc_id", snippet_paragraph(c("text"), sn).alias("paragraph"))


@book.add("F21_link_filter", "WITH l AS (SELECT doc_id, 'https://site.example/' || coalesce(project_key, 'p') || CASE doc_id % 4 WHEN 0 THEN '/page.html' WHEN 1 THEN '/file.pdf' WHEN 2 THEN '/folder/' ELSE '/index.HTM?x=1' END AS url, CASE WHEN doc_id % 5 = 0 THEN 'application/pdf' END AS mime FROM documents) SELECT doc_id FROM l WHERE mime IS NULL AND lower(regexp_extract(url, '^[a-z]+://[^?#]*/[^/?#]*\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) IN ('', 'html', 'htm', 'shtml')")
def f21(spark, d):
    from siltstone.functions.text import html_like

    tail = F.element_at(F.array(F.lit("/page.html"), F.lit("/file.pdf"), F.lit("/folder/"), F.lit("/index.HTM?x=1")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://site.example/"), F.coalesce("project_key", F.lit("p")), tail).alias("url"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "application/pdf").alias("mime"))
    return rows.where(html_like(c("url"), c("mime"))).select("doc_id")


@book.add("O23_top_k_per_group", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def o23(spark, d):
    """Top three per user by pre-aggregation: bounded buffers per task, no window over a hot key."""
    e = table(spark, d, "events")
    part = Window.partitionBy("user_id", "p").orderBy(F.desc("value"), "event_id")
    local = e.withColumn("p", F.pmod(F.xxhash64("event_id"), F.lit(16))).withColumn("r", F.row_number().over(part)).where("r <= 3")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return local.withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id", "value")
