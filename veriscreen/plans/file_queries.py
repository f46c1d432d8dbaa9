"""Queries through the readers, writers and gates: files are made from the provided tables, read back, and compared with
the tables themselves. Where a query looks for faults, it puts them in first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking, stats, wordpiece
from ..operators import articles as A
from ..operators import audit, cohorts, corpus, release, scoring
from ..sources import files, markup, sinks
from ..sources.scratch import scratch
from . import queries as Q
from .queries import SQL_ARTICLES, SQL_DECIDED, SQL_LABELLED, SQL_ROWS, query, rounded, table

_TEXT = "regexp_replace({}, '[\\x00-\\x1F]', ' ', 'g')"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _document(rows: DataFrame, payload: Column, name: str) -> str:
    """A folder with one JSON document: payload over all rows, which is a document of their size."""
    path = scratch(rows.sparkSession, name)
    rows.agg(payload.alias("value")).write.text(path)
    return path


def _lines(rows: DataFrame, name: str) -> str:
    path = scratch(rows.sparkSession, name)
    sinks.write_jsonl(rows, path)
    return path


def _by_source(values: DataFrame, name: str) -> str:
    """Text files of values(source, line, value), those of a source in a folder of its own, in the order of line."""
    path = scratch(values.sparkSession, name)
    values.repartition("source").sortWithinPartitions("source", "line").select("source", "value").write.partitionBy("source").text(path)
    return path


def _source() -> Column:
    return F.regexp_extract("path", "source=([^/]*)/", 1)


# ---- readers


@query(f"WITH {SQL_ROWS} SELECT pmid, chunk_index, label, original_label, md5(array_to_string(ids, ',')) AS ids_md5, count(*) AS n FROM w GROUP BY ALL")
def read_labelled_chunks(spark, sf_dir):
    """Window files of both roles; ids get white space at their ends, which the reader takes off."""
    rows = Q.window_rows(spark, sf_dir)
    chunks = rows.select(F.concat(F.lit("  "), "pmid", F.lit(" ")).alias("pmid"), "chunk_index", F.col("original_label").alias("label"), "input_ids", "attention_mask", F.array_repeat(F.lit(0), F.size("input_ids")).alias("token_type_ids"), F.col("label").alias("role"))
    paths = [_lines(chunks.where(f"role = {role}").drop("role"), f"windows-{role}") for role in (1, 0)]
    ids = F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").cast("binary"))
    return files.labelled_chunks(spark, paths[:1], paths[1:]).groupBy("pmid", "chunk_index", "label", "original_label", ids.alias("ids_md5")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line FROM documents) SELECT source, line, doc_id::VARCHAR AS pmid FROM r WHERE doc_id % 10 <> 3")
def read_line_numbers(spark, sf_dir):
    """Exact line numbers, blank lines counted."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 10 == 3, " ").otherwise(F.format_string('{"pmid": %d}', "doc_id")).alias("value"))
    rows = files.json_lines(spark, [_by_source(docs, "lines")])
    return rows.select(_source().alias("source"), "line", "pmid")


@query("SELECT DISTINCT md5(text) AS pmid FROM documents")
def read_json_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.concat(F.lit("\t "), F.md5(F.col("text").cast("binary")), F.lit(" 　")).alias("pmid"), "lang")
    return files.json_ids(spark, [_lines(ids, "ids")])


@query("""SELECT doc_id::VARCHAR AS pmid, md5('{"pmid":" ' || doc_id || '","lang":"' || lang || '","other":null,"n_chars":' || n_chars || '}') AS value_md5 FROM documents""")
def read_json_lines(spark, sf_dir):
    """Objects pass through as they stand; null fields are written."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("pmid"), "lang", F.lit(None).cast("string").alias("other"), "n_chars")
    return files.json_lines(spark, [_lines(rows, "objects")]).select("pmid", F.md5(F.col("value").cast("binary")).alias("value_md5"))


@query("SELECT DISTINCT (conv_id + 1)::VARCHAR AS pmid FROM conversations")
def read_numeric_ids(spark, sf_dir):
    """Ids as numbers and as text, in two files."""
    ids = table(spark, sf_dir, "conversations").select((F.col("conv_id") + 1).alias("pmid"), "turn")
    paths = [_lines(ids.where("turn % 2 = 0").select("pmid"), "numbers"), _lines(ids.where("turn % 2 = 1").select(F.col("pmid").cast("string").alias("pmid")), "texts")]
    return files.numeric_json_ids(spark, paths)


@query(f"SELECT (doc_id + 1)::VARCHAR AS pmid FROM (SELECT doc_id FROM documents ORDER BY {Q._HASH}, doc_id::VARCHAR LIMIT 100)")
def read_sampling_manifest(spark, sf_dir):
    """Ids of a sampling manifest; the reader holds its number of articles against its list."""
    chosen = cohorts.sample(Q._ids(spark, sf_dir), 100).select((F.col("pmid") + 1).cast("string").alias("pmid"), F.lit(1).alias("n_chunks"))
    payload = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.count("*").alias("sampled_articles"), F.array_sort(F.collect_list(F.struct("pmid", "n_chunks"))).alias("sampled_pmids")))
    return files.numeric_json_ids(spark, [_document(chosen, payload, "manifest")], "sampling-manifest")


@query(f"WITH {SQL_DECIDED} SELECT pmid::VARCHAR AS pmid, label, n_chunks::INTEGER AS n_chunks, round(m, 6) AS mean_positive_probability, prediction, threshold, source AS sources FROM q")
def read_predictions(spark, sf_dir):
    rows = Q.decided(spark, sf_dir).select(F.col("pmid").cast("string").alias("pmid"), "label", "n_chunks", "mean_positive_probability", "prediction", "threshold", F.array("source").alias("sources"))
    return rounded(files.predictions(spark, [_lines(rows, "predictions")]).withColumn("sources", F.array_join("sources", ",")))


@query(f"WITH {SQL_LABELLED} SELECT CASE WHEN pmid % 3 = 0 THEN 'DEMO-' || pmid ELSE pmid::VARCHAR END AS pmid, md5(source) AS title_md5, md5(text) AS abstract_md5, CASE WHEN pmid % 3 = 0 THEN 'demo-only' ELSE 'retrieved' END AS data_status, label FROM l")
def read_raw_articles(spark, sf_dir):
    """Ids of two forms, as the status of an article asks for."""
    demo = F.col("pmid") % 3 == 0
    rows = Q.labelled(spark, sf_dir).select(F.when(demo, F.concat(F.lit("DEMO-"), F.col("pmid").cast("string"))).otherwise(F.col("pmid").cast("string")).alias("pmid"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.when(demo, "demo-only").otherwise("retrieved").alias("data_status"), "label")
    return files.raw_articles(spark, [_lines(rows, "articles")]).select("pmid", F.md5(F.col("title").cast("binary")).alias("title_md5"), F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "data_status", "label")


@query("SELECT source, doc_id::VARCHAR AS pmid, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line FROM documents")
def read_id_lists(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("value"))
    return files.id_list(spark, [_by_source(ids, "lists")]).select(_source().alias("source"), "pmid", "line")


@query("SELECT count(*) AS n, 0::BIGINT AS descents, max(md5(source || doc_id)) AS last FROM documents")
def write_ids_by_code_points(spark, sf_dir):
    """A list that is written in the order of code points has no descent within a file, nor from one file to the next."""
    ids = table(spark, sf_dir, "documents").select(F.md5(F.concat("source", F.col("doc_id").cast("string")).cast("binary")).alias("pmid"))
    path = scratch(spark, "ordered")
    sinks.write_ids(ids, path, numeric=False)
    rows = files.id_list(spark, [path])
    ends = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("pmid").alias("low"), F.max("pmid").alias("high"), F.min_by("pmid", "line").alias("first"), F.max_by("pmid", "line").alias("last"))
    order = Q.Window.orderBy("path")  # a row for each file
    ends = ends.withColumn("before", F.lag("high").over(order))
    bad = F.count_if((F.col("low") != F.col("first")) | (F.col("high") != F.col("last")) | (F.col("before") >= F.col("low")))
    return ends.agg(F.sum("n").alias("n"), bad.alias("descents"), F.max("high").alias("last"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def read_csv_table(spark, sf_dir):
    path = scratch(spark, "csv")
    table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).write.csv(path, header=True)
    return files.csv_table(spark, path, "lang string, source string, n long, chars long")


@query(f"{Q._SPLIT} SELECT pmid::VARCHAR AS pmid, label, split, 1::BIGINT AS n_chunks FROM sp")
def read_split_manifest(spark, sf_dir):
    rows = Q._split(spark, sf_dir).select(F.col("pmid").cast("string").alias("pmid"), "label", "split", F.lit(1).alias("n_chunks"))
    payload = F.to_json(F.struct(F.lit(42).alias("seed"), F.array_sort(F.collect_list(F.struct("pmid", "label", "split", "n_chunks"))).alias("articles")))
    return files.manifest_ids(spark, _document(rows, payload, "split"))


@query(f"SELECT threshold FROM ({Q._threshold_sql('youden')})")
def read_threshold(spark, sf_dir):
    best = A.choose_threshold(Q.scored_articles(spark, sf_dir)).select("threshold")
    value = files.threshold(spark, _document(best, F.to_json(F.struct(F.first("threshold").alias("threshold"), F.lit("mean").alias("aggregation"))), "threshold"))
    return rounded(spark.createDataFrame([(release.check_threshold({"threshold": value, "aggregation": "mean", "run_id": "r"}, "r"),)], "threshold double"))


@query("WITH c AS (SELECT source AS cohort, count(DISTINCT md5(text)) AS n FROM documents GROUP BY source) SELECT cohort, CASE WHEN n % 2 = 0 THEN 'draft' ELSE 'verified-historical' END AS data_status, n % 5 < 2 AS verified FROM c WHERE n % 2 = 0 OR n % 5 < 2")
def read_cohort_manifest(spark, sf_dir):
    """Cohorts whose provenance is not as it must be."""
    own = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("cohort_id")).agg(F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("unique_pmids"))
    own = own.withColumns({"data_status": F.when(F.col("unique_pmids") % 2 == 0, "draft").otherwise("verified-historical"), "paper_cohort_verified": F.col("unique_pmids") % 5 < 2, "path": F.col("cohort_id")})
    payload = F.to_json(F.struct(F.collect_list(F.struct("cohort_id", "path", "unique_pmids", "data_status", "paper_cohort_verified")).alias("cohorts")))
    return release.provenance_violations(files.cohort_manifest(spark, _document(own, payload, "cohorts")))


_XML_SQL = f"x AS (SELECT doc_id, source, lang, {_TEXT.format('text')} AS t FROM documents)"


def _xml(spark, sf_dir) -> DataFrame:
    """Articles in XML documents of 20: markup within the title, an abstract of two sections, or none for every fifth. Every third has a comment that looks like an id
    before its id, every seventh its text as character data."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    bare = F.regexp_replace("text", r"[\x00-\x1F]", " ")
    data = F.concat(F.lit("<![CDATA["), F.replace(bare, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
    docs = table(spark, sf_dir, "documents").withColumn("t", F.when(F.col("doc_id") % 7 == 0, data).otherwise(escaped(bare)))
    remark = F.when(F.col("doc_id") % 3 == 0, "<!-- <PMID>9</PMID> </PubmedArticle> -->").otherwise("")
    abstract = F.when(F.col("doc_id") % 5 == 0, "<Abstract/>").otherwise(F.concat(F.lit('<Abstract><AbstractText Label="A">'), "lang", F.lit("</AbstractText><AbstractText>"), "t", F.lit("</AbstractText></Abstract>")))
    one = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), remark, F.lit('<PMID Version="1">'), F.col("doc_id").cast("string"), F.lit("</PMID><Article><ArticleTitle> Of <i>"), "source", F.lit("</i> in <b>"), "lang", F.lit("</b>. </ArticleTitle>"), abstract, F.lit("</Article></MedlineCitation></PubmedArticle>"))
    rows = docs.select(F.expr("doc_id div 20").alias("k"), one.alias("x"))
    return rows.groupBy("k").agg(F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.collect_list("x"), "\n"), F.lit("</PubmedArticleSet>")).alias("xml"))


@query(rf"WITH {_XML_SQL} SELECT doc_id::VARCHAR AS pmid, 'Of ' || source || ' in ' || lang || '.' AS title, md5(CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || chr(10) || trim(t, ' ') END) AS abstract_md5, 1 AS label FROM x")
def parse_xml_articles(spark, sf_dir):
    out = markup.parse_articles(_xml(spark, sf_dir), 1)
    return out.select("pmid", "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "label")


@query("SELECT doc_id::VARCHAR AS pmid FROM documents WHERE doc_id % 5 = 0")
def missing_abstracts(spark, sf_dir):
    return markup.missing_abstracts(markup.parse_articles(_xml(spark, sf_dir), 1))


_LISTS = "c AS (SELECT source, string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10) AS c FROM documents GROUP BY source)"


@query(f"WITH {_LISTS} SELECT source, strlen(c)::BIGINT AS size, sha256(c) AS sha256, sha1('blob ' || strlen(c) || chr(0) || c) AS git_sha1 FROM c")
def file_fingerprints(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("value"))
    return files.fingerprints(spark, [f"{_by_source(ids, 'blobs')}/source=*"]).select(_source().alias("source"), "size", "sha256", "git_sha1")


@query(f"WITH {_LISTS}, s AS (SELECT source, strlen(c) AS n FROM c) SELECT source AS name, unnest(CASE WHEN n % 2 = 0 THEN ['size'] ELSE ['git_sha1', 'rows'] END) AS rule FROM s")
def archived_blob_violations(spark, sf_dir):
    """Expected sizes are wrong for files of even size, hashes and row counts for the others."""
    ids = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("value"))
    path = _by_source(ids, "archive")
    counts = files.id_list(spark, [path]).groupBy(_source().alias("name")).agg(F.count("*").alias("rows"), F.countDistinct("pmid").alias("ids"))
    found = files.fingerprints(spark, [f"{path}/source=*"]).select(_source().alias("name"), "size", "git_sha1").join(counts, "name")
    even = F.col("size") % 2 == 0
    expected = found.select("name", (F.col("size") + F.when(even, 1).otherwise(0)).alias("size"), F.when(even, F.col("git_sha1")).otherwise("0" * 40).alias("git_sha1"), (F.col("rows") + F.when(even, 0).otherwise(1)).alias("rows"), "ids")
    return release.blob_violations(found, expected)


@query("SELECT lang || ' group' AS name, lang || '/b=' || count(*) || '.jsonl' AS path FROM documents GROUP BY lang")
def group_specifications(spark, sf_dir):
    """Groups as a command names them, one for each language; only the first equals sign counts."""
    langs = table(spark, sf_dir, "documents").groupBy("lang").count().orderBy("lang").collect()  # a row a language
    specs = files.group_specs([f" {r.lang} group ={r.lang}/b={r['count']}.jsonl" for r in langs])
    return spark.createDataFrame(list(specs.items()), "name string, path string")


@query("WITH i AS (SELECT DISTINCT doc_id AS d FROM documents), p AS (SELECT d, (row_number() OVER (ORDER BY d) - 1) // 100 AS batch FROM i) SELECT batch, count(*) AS n, md5(string_agg(d::VARCHAR, ',' ORDER BY d)) AS ids_md5 FROM p GROUP BY batch")
def fetch_request_batches(spark, sf_dir):
    out = markup.request_batches(Q._ids(spark, sf_dir), 100)
    return out.select("batch", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",").cast("binary")).alias("ids_md5"))


@query("SELECT doc_id AS pmid, 'missing' AS side FROM documents WHERE doc_id % 9 = 4 UNION ALL SELECT doc_id + 10000000, 'unexpected' FROM documents WHERE doc_id % 13 = 2")
def requested_against_returned(spark, sf_dir):
    """A ninth of the ids is left out, others come that nobody asked for."""
    ids = Q._ids(spark, sf_dir)
    other = ids.where("pmid % 13 = 2").select((F.col("pmid") + 10_000_000).alias("pmid"))
    return markup.returned_differences(ids, ids.where("pmid % 9 <> 4").union(other))


# ---- rules


_FAULTY = "CASE WHEN line % 11 = 1 THEN [-1, 0] WHEN line % 11 = 2 THEN []::INTEGER[] ELSE [5, 6] END AS ids, CASE WHEN line % 7 = 1 THEN [0, 0] WHEN line % 7 = 2 THEN [1, 2] WHEN line % 7 = 3 THEN [1] ELSE [1, 1] END AS mask, CASE WHEN line % 5 = 1 THEN [0, -3] WHEN line % 5 = 2 THEN [0, 9] ELSE [0, 0] END AS kinds, CASE WHEN line % 13 = 1 THEN NULL WHEN line % 13 = 2 THEN '' ELSE line::VARCHAR END AS pmid, CASE WHEN line % 17 = 1 THEN -1 WHEN line % 17 = 2 THEN NULL ELSE 0 END AS chunk_index"


@query(f"""WITH f AS (SELECT doc_id AS line, {_FAULTY.replace('line', 'doc_id')} FROM documents),
r AS (SELECT line, pmid, [CASE WHEN pmid IS NULL THEN 'missing_pmid' END, CASE WHEN pmid = '' THEN 'empty_pmid' END, CASE WHEN chunk_index IS NULL OR chunk_index < 0 THEN 'chunk_index' END, CASE WHEN len(ids) = 0 THEN 'empty_array' END,
CASE WHEN len(ids) <> len(mask) OR len(ids) <> len(kinds) THEN 'unequal_lengths' END, CASE WHEN list_min(ids) < 0 THEN 'negative_id' END, CASE WHEN list_max(mask) > 1 THEN 'mask_values' END, CASE WHEN list_max(mask) = 0 THEN 'mask_all_zero' END,
CASE WHEN list_min(kinds) < 0 THEN 'negative_type' END, CASE WHEN list_max(kinds) >= 2 THEN 'type_beyond_vocabulary' END] AS v FROM f)
SELECT unnest(list_filter(v, lambda x: x IS NOT NULL)) AS rule, line, pmid FROM r""")
def window_rule_violations(spark, sf_dir):
    """Each rule that a row shows by itself is broken by some rows, several by one."""
    k = F.col("line")
    ints = lambda *x: F.array(*(F.lit(y) for y in x)).cast("array<int>")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.lit("documents").alias("path")).select(
        "path", "line", F.when(k % 13 == 1, None).when(k % 13 == 2, "").otherwise(k.cast("string")).alias("pmid"), F.when(k % 17 == 1, -1).when(k % 17 == 2, None).otherwise(0).alias("chunk_index"),
        F.when(k % 11 == 1, ints(-1, 0)).when(k % 11 == 2, ints()).otherwise(ints(5, 6)).alias("input_ids"), F.when(k % 7 == 1, ints(0, 0)).when(k % 7 == 2, ints(1, 2)).when(k % 7 == 3, ints(1)).otherwise(ints(1, 1)).alias("attention_mask"),
        F.when(k % 5 == 1, ints(0, -3)).when(k % 5 == 2, ints(0, 9)).otherwise(ints(0, 0)).alias("token_type_ids"),
    )
    return corpus.row_violations(rows, types=2).select("rule", "line", "pmid")


@query("""WITH v AS (SELECT doc_id AS line, CASE WHEN doc_id % 5 = 0 THEN '{"pmid":"1","label":1}' WHEN doc_id % 5 = 1 THEN '{"pmid":"1","label":true}' WHEN doc_id % 5 = 2 THEN '{"pmid":"1","label":1.5}' WHEN doc_id % 5 = 3 THEN '[1]' ELSE '{"pmid":"1"' END AS value FROM documents)
SELECT value, count(*) AS n, CASE WHEN value = '{"pmid":"1","label":1}' THEN count(*) ELSE 0 END AS valid FROM v GROUP BY value""")
def strict_json_objects(spark, sf_dir):
    """Lines that are no JSON objects, or hold true or a fraction for an integer, are not valid."""
    kinds = ['{"pmid":"1","label":1}', '{"pmid":"1","label":true}', '{"pmid":"1","label":1.5}', "[1]", '{"pmid":"1"']
    path = scratch(spark, "objects")
    table(spark, sf_dir, "documents").select(F.element_at(F.array(*(F.lit(x) for x in kinds)), (F.col("doc_id") % 5 + 1).cast("int")).alias("value")).write.text(path)
    rows = files.parsed(files.numbered_lines(spark, [path]), files.T.StructType([files.T.StructField("pmid", files.T.StringType()), files.T.StructField("label", files.T.IntegerType())]))
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


@query(f"""WITH {SQL_ARTICLES}, f AS (SELECT pmid, CASE WHEN pmid % 7 = 1 THEN 2 ELSE label END AS label, CASE WHEN pmid % 5 = 1 THEN NULL WHEN pmid % 5 = 2 THEN 1.25 ELSE m END AS m, CASE WHEN pmid % 9 = 1 THEN -0.5 ELSE 0.5 END AS t FROM a)
SELECT unnest(list_filter([CASE WHEN label NOT IN (0, 1) THEN 'label' END, CASE WHEN m IS NULL OR m < 0 OR m > 1 THEN 'score' END, CASE WHEN t < 0 OR t > 1 THEN 'threshold' END], lambda x: x IS NOT NULL)) AS rule, pmid FROM f""")
def metric_input_violations(spark, sf_dir):
    k, score = F.col("pmid"), F.col("mean_positive_probability")
    rows = Q.scored_articles(spark, sf_dir).select("pmid", F.when(k % 7 == 1, 2).otherwise(F.col("label")).alias("label"), F.when(k % 5 == 1, None).when(k % 5 == 2, 1.25).otherwise(score).alias("mean_positive_probability"), F.when(k % 9 == 1, -0.5).otherwise(0.5).alias("threshold"))
    return A.metric_violations(rows)


@query("SELECT doc_id AS pmid, (2 + (doc_id % 4 = 1)::INTEGER)::BIGINT AS n_chunks, 'manifest' AS only_in FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 2, 'file' FROM documents WHERE doc_id % 4 = 1")
def sampled_count_differences(spark, sf_dir):
    """The manifest claims a window too many for a quarter of the articles."""
    ids = Q._ids(spark, sf_dir).distinct()
    chunks = ids.withColumn("chunk_index", F.explode(F.array(F.lit(0), F.lit(1))))
    return release.sampled_differences(ids.withColumn("n_chunks", F.when(F.col("pmid") % 4 == 1, 3).otherwise(2)), chunks)


@query("WITH m AS (SELECT DISTINCT md5(text) AS h, source AS c FROM documents), g AS (SELECT h, list(c) AS o FROM m GROUP BY h), e AS (SELECT list_has_any(o, ['src0', 'src1']) AS a, list_has_any(o, ['src1', 'src2']) AS b, list_has_any(o, ['src3', 'src4']) AS d FROM g) SELECT 'other' AS name, count(*) FILTER (a <> b) = 0 AS equal, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second FROM e UNION ALL SELECT 'same', true, 0, 0")
def cohort_set_equality(spark, sf_dir):
    return cohorts.set_equality(Q.members(spark, sf_dir), {"other": (["src0", "src1"], ["src1", "src2"]), "same": (["src4", "src3"], ["src3", "src4"])})


# ---- scores


@query("SELECT doc_id AS pmid, round(1 / (1 + exp((n_chars % 11 - 5)::DOUBLE / 2 - (n_chars % 7 - 3)::DOUBLE / 3)), 6) AS positive_probability FROM documents")
def softmax_probability(spark, sf_dir):
    n = F.col("n_chars")
    return rounded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"), stats.softmax_positive((n % 11 - 5) / 2.0, (n % 7 - 3) / 3.0).alias("positive_probability")))


@query(f"WITH {SQL_ROWS} SELECT path, line, chunk_index, round(1 / (1 + exp(-((list_sum(ids) + len(ids)) % 97 - 48)::DOUBLE / 16)), 6) AS positive_probability FROM w")
def chunk_model_scores(spark, sf_dir):
    """The slot for a model, filled by one that adds up token ids and mask."""
    rows = Q.window_rows(spark, sf_dir).select("path", "line", "chunk_index", "input_ids", "attention_mask")

    def scorer():
        import numpy as np

        def score(batch):
            if not len(batch):
                return np.zeros(0)
            size = batch["input_ids"].map(len).to_numpy()
            ids, mask = (np.concatenate(batch[c].to_list()).astype(np.int64) for c in ("input_ids", "attention_mask"))
            total = np.bincount(np.repeat(np.arange(len(size)), size), ids + mask, len(size))
            return 1 / (1 + np.exp(-(total % 97 - 48) / 16))

        return score

    return rounded(scoring.score_batches(rows, scorer, ("input_ids", "attention_mask")))


@query("""WITH s AS (SELECT doc_id AS pmid, (doc_id % 121)::INTEGER AS step FROM documents), d AS (SELECT pmid, step, (step - 12)::DOUBLE / 88 AS x FROM s)
SELECT pmid, step, kind, round(CASE WHEN step < 12 THEN step / 12.0 WHEN x >= 1 THEN 0 WHEN kind = 'linear' THEN 1 - x WHEN kind = 'cosine' THEN 0.5 * (1 + cos(pi() * x)) ELSE 0.5 * (1 + cos(pi() * (3 * x - floor(3 * x)))) END, 6) AS factor FROM d, (VALUES ('linear'), ('cosine'), ('cosine_with_restarts')) k(kind)""")
def learning_rate_factors(spark, sf_dir):
    """Articles take their turns in steps; the factor of each one's step by three schedules."""
    rows = Q._ids(spark, sf_dir).withColumn("step", (F.col("pmid") % 121).cast("int"))
    kinds = ("linear", "cosine", "cosine_with_restarts")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), scoring.learning_rates(F.col("step"), 100, 0.12, k, 3).alias("factor")) for k in kinds))).alias("x")
    return rounded(rows.select("pmid", "step", each).select("pmid", "step", "x.kind", "x.factor"))


@query("WITH h AS (SELECT source, (doc_id % 9)::INTEGER AS epoch, round(avg(n_chars % 50), 1) AS loss, round(avg(n_chars % 7), 1) AS area FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY loss, area DESC, epoch) AS k FROM h) SELECT source, epoch FROM r WHERE k = 1")
def checkpoint_choice(spark, sf_dir):
    """The epoch that selection keeps, for each source a history of nine."""
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").groupBy("source", (F.col("doc_id") % 9).cast("int").alias("epoch")).agg(F.round(F.avg(n % 50), 1).alias("loss"), F.round(F.avg(n % 7), 1).alias("area"))
    return scoring.best_epochs(rows, "source")


@query(f"WITH t AS (SELECT doc_id, lang || ' ' || source || ' ' || doc_id AS t FROM documents), c AS (SELECT doc_id, string_split(t, ' ') AS w FROM t), i AS (SELECT doc_id, flatten(list_transform(w, lambda x: list_transform(range(1, length(x) + 1), lambda i: 2 + instr('{LETTERS}', substr(x, i::BIGINT, 1)) - 1 + CASE WHEN i > 1 THEN {len(LETTERS)} ELSE 0 END))) AS ids FROM c) SELECT doc_id, array_to_string(ids, ',') AS ids FROM i")
def wordpiece_ids(spark, sf_dir):
    """Sub-word ids by a vocabulary of single letters and digits, at the beginning of words and within them."""
    vocabulary = [*wordpiece.SPECIAL, *LETTERS, *(f"##{x}" for x in LETTERS), "[UNK]"]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.upper("lang"), "source", F.col("doc_id").cast("string")).alias("t"))
    return docs.select("doc_id", F.array_join(F.transform(wordpiece.encoder(vocabulary)(F.col("t")), lambda x: x.cast("string")), ",").alias("ids"))


@query(f"SELECT doc_id AS pmid, {Q._HASH} AS rank FROM documents")
def hash_ranks(spark, sf_dir):
    return Q._ids(spark, sf_dir).select("pmid", ranking.sample_rank(42, F.col("pmid").cast("string")).alias("rank"))


# ---- documents and reports


@query(f"WITH {SQL_DECIDED}, g AS (SELECT lang, count(*) AS n, sum(prediction)::BIGINT AS k, avg(m) AS m FROM q GROUP BY lang) SELECT lang AS \"group\", '| ' || lang || ' | ' || n || ' | ' || printf('%.6f', round(m, 9)) || ' | ' || printf('%.6f', round(k / n, 9)) || ' |' AS line FROM g")
def report_lines(spark, sf_dir):
    """Group lines of the Markdown report, without their intervals."""
    own = audit.group_summary(Q.decided(spark, sf_dir), "lang").withColumnRenamed("lang", "group").withColumns({c: F.round(c, 9) for c in ("mean", "predicted_positive_rate")})
    path = scratch(spark, "report")
    report = sinks.report([r.asDict() for r in own.collect()], [], 0.95, 200, 42)  # a row for each group
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.text(path)
    rows = files.numbered_lines(spark, [path])
    heads = rows.where(F.col("value").startswith("| group |")).agg(F.min("line").alias("first"), F.max("line").alias("last"))  # the tables of groups
    cells = F.transform(F.split(F.expr("substring(value, 2, length(value) - 2)"), "[|]"), lambda x: F.trim(x))
    own = rows.crossJoin(F.broadcast(heads)).where("line > first + 1 and line < last and startswith(value, '| ')").withColumn("c", cells)
    own = own.where(F.size("c") == 6)
    return own.select(F.col("c")[0].alias("group"), F.format_string("| %s | %s | %s | %s |", *(F.col("c")[i] for i in (0, 1, 2, 4))).alias("line"))


@query(f"""WITH {SQL_DECIDED} SELECT count(*) AS n_articles, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 0) AS tn, 'veriscreen' AS made_by, true AS refused FROM q""")
def result_document(spark, sf_dir):
    """A result document, written once: a second writing into its folder is refused."""
    path = scratch(spark, "results")
    counts = A.metrics(Q.decided(spark, sf_dir)).select("n_articles", "tp", "tn", F.lit("veriscreen").alias("made_by"))
    sinks.write_jsonl(counts, path)
    try:
        sinks.write_jsonl(counts, path)
        refused = False
    except Exception as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return spark.read.schema("n_articles long, tp long, tn long, made_by string").json(path).withColumn("refused", F.lit(refused))


@query("SELECT doc_id AS pmid FROM documents JOIN labels USING (doc_id) ORDER BY doc_id::VARCHAR LIMIT 10")
def overlap_preview(spark, sf_dir):
    """The first ten shared ids, as an error message shows them."""
    return cohorts.leakage(Q._ids(spark, sf_dir), Q._listed(spark, sf_dir)).orderBy(F.col("pmid").cast("string")).limit(10)


@query(f"WITH {SQL_ROWS} SELECT count(*) AS n, 0::BIGINT AS descents FROM (SELECT DISTINCT pmid, chunk_index FROM w)")
def windows_in_order(spark, sf_dir):
    """Windows are written by article and number: no descent within a file."""
    path = scratch(spark, "sorted")
    sinks.write_ordered(corpus.merged(Q.window_rows(spark, sf_dir)).select("pmid", "chunk_index", "input_ids"), path)
    rows = files.parsed(files.numbered_lines(spark, [path]), files.T.StructType(files.CHUNK.fields[:2]))
    own = Q.Window.partitionBy("path").orderBy("line")
    now = F.struct("pmid", "chunk_index")
    return rows.withColumn("bad", F.lag(now).over(own) >= now).agg(F.count("*").alias("n"), F.count_if("bad").alias("descents"))


@query(f"{Q._PAIRS.replace('x.lang < y.lang', chr(39) + 'fr,en,de,es' + chr(39) + ' IS NOT NULL AND instr(' + chr(39) + 'fr,en,de,es' + chr(39) + ', x.lang) < instr(' + chr(39) + 'fr,en,de,es' + chr(39) + ', y.lang)')} SELECT first_group, second_group, round(dm, 6) AS mean_difference, round(dr, 6) AS rate_difference, round(dm / sqrt(pv), 6) AS cohens_d FROM p")
def pairwise_in_command_order(spark, sf_dir):
    """Pairs in the order in which a command names its groups."""
    return rounded(audit.pairwise(Q.decided(spark, sf_dir), "lang", groups=["fr", "en", "de", "es"]))


_RATES = "SELECT lang AS g, prediction::DOUBLE AS x, pmid AS id FROM q"


@query(f"WITH {SQL_DECIDED}, {Q._boot(_RATES)} SELECT x.g AS first_group, y.g AS second_group, round(quantile_cont(x.m - y.m, 0.025), 6) AS low, round(quantile_cont(x.m - y.m, 0.975), 6) AS high FROM me x JOIN me y ON x.replicate = y.replicate AND x.g < y.g GROUP BY ALL")
def bootstrap_rate_diff_ci(spark, sf_dir):
    return rounded(audit.bootstrap_differences(Q.decided(spark, sf_dir), "lang", "prediction", Q.DRAWN))


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id::VARCHAR AS pmid, any_value(n) AS n_chunks, round(avg(('0x' || substr(md5(conv_id || ':' || turn), 1, 8))::BIGINT::DOUBLE / 4294967295.0), 6) AS mean_positive_probability FROM r GROUP BY conv_id")
def streamed_article_scores(spark, sf_dir):
    """Article means kept by a stream over a folder of window predictions."""
    from ..streaming import incremental

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("pmid"), F.col("turn").cast("int").alias("chunk_index"), F.lit(1).alias("label"), scoring.surrogate(F.col("conv_id"), F.col("turn")).alias("positive_probability"))
    source, target, checkpoint = (scratch(spark, f"stream-{x}") for x in ("source", "target", "checkpoint"))
    rows.write.parquet(source)
    incremental.start(spark, source, target, checkpoint, once=True).awaitTermination()
    return rounded(incremental.article_scores(spark, target).select("pmid", "n_chunks", "mean_positive_probability"))
