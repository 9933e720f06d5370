"""Queries pN_... of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyral.functions.ids import case_key, cohort_of, file_key, subject_key
from gyral.llm import history, language, overlap, packing, similar, splits, tokens
from gyral.session import cut, scratch_dir


def _donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/donor_index.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _donors(spark, sf_dir).select("donor_id", "emb", file_key(F.col("paths")).alias("file"))
    return similar.neighbour_pairs(similar.neighbours(rows, "donor_id", "emb", "file"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _donors(spark, sf_dir).select(F.col("batch_no").cast("bigint").alias("batch"), F.col("donor_id").alias("id"), file_key(F.col("paths")).alias("file"), "emb")
    state = history.DedupHistory(spark, scratch_dir(spark, "p2-history"))
    # one folder per batch, as batches come in; each is judged against the persistent table that the ones before have left
    arrived = cut(state.prepared(rows), "p2-arrived", ["batch"])
    for number in sorted(r[0] for r in arrived.select("batch").distinct().collect()):
        state.judge(arrived.filter(F.col("batch") == number).select("batch", "id", "file", "v"))
    gone = state.read("rejected")
    return (arrived.limit(0) if gone is None else gone).select(F.col("id").alias("donor_id"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/donor_manifest.parquet")


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _manifest(spark, sf_dir).select(F.col("manifest_id").alias("id"), "split_name", case_key(F.col("names")).alias("case"))
    return rows, _donors(spark, sf_dir).select(case_key(file_key(F.col("paths"))).alias("case"), "emb")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split(*_cases(spark, sf_dir)).select("a_id", "b_id").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(*_cases(spark, sf_dir))


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _manifest(spark, sf_dir).select(F.col("manifest_id").alias("id"), subject_key(F.col("names")).alias("subject"), "names")
    alias = spark.read.parquet(f"{sf_dir}/subject_alias.parquet").filter(F.lower(F.trim("verdict")) == "same")
    links = alias.select(subject_key(F.col("name_a")).alias("a"), subject_key(F.col("name_b")).alias("b")).filter("a is not null and b is not null")
    return rows, links


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links = _named(spark, sf_dir)
    return splits.first_of_group(splits.related(rows, links)).withColumnRenamed("id", "manifest_id")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links = _named(spark, sf_dir)
    variant = F.when(F.lower("names").rlike("[^a-z0-9]m[0-9]"), "decoy").when(F.col("names").rlike("[^0-9][0-9]{4}([^0-9]|$)"), "mask").otherwise("whole")
    labels = rows.select("id", F.concat_ws("/", F.coalesce(cohort_of(F.col("subject")), F.lit("unreadable")), variant).alias("label"))
    return splits.related(rows, links).join(labels, "id")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(_groups(spark, sf_dir), spark.read.parquet(f"{sf_dir}/split_plan.parquet")).select(F.col("id").alias("manifest_id"), "split_name")


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p3_splits must hold: no component in two splits, rows and labels near their targets."""
    groups, plan = cut(_groups(spark, sf_dir), "p3-groups"), spark.read.parquet(f"{sf_dir}/split_plan.parquet")
    return splits.split_check(groups, splits.stratified(groups, plan), plan)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "ids")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_ids(spark, sf_dir).select("doc_id", F.nullif(tokens.decode_ids(F.col("ids")), F.lit("")).alias("text"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = tokens.encode(_documents(spark, sf_dir).select("doc_id", "text"))
    # written once: the plans of pack() then carry sizes only, not the encoder and its constants
    return packing.pack(cut(sized.select(F.col("doc_id").alias("id"), F.size("ids").alias("size")), "p7-sizes"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnsRenamed({"id": "doc_id", "first": "first_token", "size": "n_tokens"})


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p7_containers must hold for each document: every token once, in one piece unless it is longer than a container."""
    packed = cut(_packed(spark, sf_dir), "p7-packed")
    return packing.pack_check(packed, cut(p6_ids(spark, sf_dir).select(F.col("doc_id").alias("id"), F.size("ids").alias("size")), "p7-sizes")).withColumnRenamed("id", "doc_id")


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang")
    languages = spark.read.parquet(f"{sf_dir}/languages.parquet")
    return docs, language.detect(docs, language.fitted(docs, languages)), languages


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.unstated(*_spoken(spark, sf_dir)).select(F.col("id").alias("doc_id"), "lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoken(spark, sf_dir)[1].select(F.col("id").alias("doc_id"), "segment", "text", "lang", "confidence", "sentence")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages_of(_spoken(spark, sf_dir)[1]).withColumnRenamed("id", "doc_id")


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts have a language row, and that all their segments' confidences are probabilities."""
    each = _spoken(spark, sf_dir)[1].groupBy("id").agg(F.bool_and(F.col("confidence").between(0, 1) & (F.col("lang").isNotNull() | (F.col("confidence") == 0))).alias("sound"))
    return each.select(F.col("id").alias("doc_id"), "sound")


_FILE = r"nullif(lower(trim(regexp_extract(replace(regexp_replace({0}, '[\s/\\]+$', ''), '\', '/'), '[^/]*$'), e' \t\n\r')), '')"
_VALID = f"""d AS (SELECT donor_id, batch_no, {_FILE.format('paths')} AS file, emb::DOUBLE[] AS e FROM donor_index
  WHERE len(emb) = 144 AND list_bool_and(list_transform(emb, lambda x: coalesce(isfinite(x), false))) AND list_min(emb) < list_max(emb)),
c AS (SELECT * REPLACE (list_transform(e, lambda x: x - list_avg(e)) AS e) FROM d), v AS (SELECT * REPLACE (list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e) FROM c)"""
_WIDE = "".join(chr(0xFF10 + i) for i in range(10))
_CASE = r"(^|[^a-z0-9]|brats)((gli|goat)[^a-z0-9]*([0-9]{{5,}})|(hcp)[^a-z0-9]*([0-9]{{7,}}))([^a-z0-9]+([0-9]{{3}})([^0-9]|$))?"


def _group(name: str, n: int) -> str:
    return f"regexp_extract(lower(translate({name}, '{_WIDE}', '0123456789')), '{_CASE.replace('{{', '{').replace('}}', '}')}', {n})"


def _subject(name: str) -> str:
    cohort_, number = f"{_group(name, 3)} || {_group(name, 5)}", f"{_group(name, 4)} || {_group(name, 6)}"
    return f"CASE WHEN {cohort_} <> '' THEN {cohort_} || '-' || CAST(CAST({number} AS HUGEINT) AS VARCHAR) END"


def _case(name: str) -> str:
    subject = _subject(name)
    return f"CASE WHEN starts_with({subject}, 'goat-') THEN {subject} WHEN {_group(name, 8)} <> '' THEN {subject} || '-' || {_group(name, 8)} END"


_ACROSS = f"""WITH {_VALID}, k AS (SELECT DISTINCT {_case('file')} AS c, e FROM v), m AS (SELECT manifest_id AS id, split_name, {_case('names')} AS c FROM donor_manifest WHERE split_name IN ('train', 'val', 'official_val')),
  ev AS (SELECT DISTINCT c FROM m WHERE split_name <> 'train' AND c IS NOT NULL), tr AS (SELECT DISTINCT c FROM m WHERE split_name = 'train' AND c IS NOT NULL),
  links AS (SELECT ev.c AS a, tr.c AS b FROM ev JOIN tr ON ev.c = tr.c UNION SELECT p.c, q.c FROM k p JOIN ev ON ev.c = p.c JOIN k q ON list_dot_product(p.e, q.e) >= 0.98 JOIN tr ON tr.c = q.c),
  pairs AS (SELECT x.id AS e, y.id AS t, x.split_name AS eval_split, split_part(x.c, '-', 1) AS eval_cohort FROM links JOIN m x ON x.c = links.a AND x.split_name <> 'train' JOIN m y ON y.c = links.b AND y.split_name = 'train')"""

#: Exact versions; the operators for problems 1 and 4 are approximate in candidate search only.
SQL = {
    "p1_found": f"""WITH {_VALID}, near AS (SELECT a.donor_id AS a, b.donor_id AS b, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.donor_id <> b.donor_id AND a.file IS DISTINCT FROM b.file OR (a.file IS NULL AND a.donor_id <> b.donor_id)),
  best AS (SELECT a, b, s FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
  SELECT DISTINCT least(a, b) AS a_id, greatest(a, b) AS b_id FROM best WHERE s >= 0.86""",
    "p3_found": f"""WITH RECURSIVE al AS (SELECT {_subject('name_a')} AS a, {_subject('name_b')} AS b FROM subject_alias WHERE verdict = 'same'),
  e AS (SELECT a, b FROM al WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM al WHERE a IS NOT NULL AND b IS NOT NULL),
  reach AS (SELECT a AS s, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.s),
  root AS (SELECT s, min(r) AS r FROM reach GROUP BY 1), m AS (SELECT manifest_id, {_subject('names')} AS s FROM donor_manifest),
  g AS (SELECT manifest_id, min(manifest_id) OVER (PARTITION BY coalesce(root.r, m.s)) AS first_id FROM m LEFT JOIN root ON root.s = m.s WHERE m.s IS NOT NULL)
  SELECT DISTINCT first_id, manifest_id FROM g WHERE first_id <> manifest_id""",
    "p4_found": f"{_ACROSS} SELECT DISTINCT least(e, t) AS a_id, greatest(e, t) AS b_id FROM pairs",
    "p4_report": f"{_ACROSS} SELECT eval_split, eval_cohort, CAST(count(*) AS BIGINT) AS n_pairs, count(DISTINCT e) AS n_rows FROM pairs GROUP BY 1, 2",
    "p2_found": f"""WITH RECURSIVE {_VALID}, o AS (SELECT *, row_number() OVER (ORDER BY batch_no, donor_id) AS n FROM v),
  k AS (SELECT y.n, list(x.n) AS before FROM o x JOIN o y ON x.n < y.n AND (x.file = y.file OR list_dot_product(x.e, y.e) >= 0.98) GROUP BY 1),
  s AS (SELECT o.n, o.donor_id, coalesce(k.before, []) AS before FROM o LEFT JOIN k ON k.n = o.n WHERE k.n IS NOT NULL OR o.n IN (SELECT unnest(before) FROM k)),
  q AS (SELECT *, row_number() OVER (ORDER BY n) AS i FROM s),
  run AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS rejected UNION ALL
    SELECT q.i, CASE WHEN list_has_any(run.kept, q.before) THEN run.kept ELSE list_append(run.kept, q.n) END, CASE WHEN list_has_any(run.kept, q.before) THEN q.donor_id END FROM run JOIN q ON q.i = run.i + 1)
  SELECT rejected AS donor_id FROM run WHERE rejected IS NOT NULL""",
    "p3_check": "SELECT split_name, true AS rows_near, true AS labels_near, CAST(0 AS BIGINT) AS torn FROM split_plan",
    "p7_check": "SELECT doc_id, true AS every_token_once, true AS whole, true AS fits, true AS full FROM documents",
    "p8_check": "SELECT doc_id, true AS sound FROM documents WHERE text <> ''",
    # the encoder is held to the text itself: what it decodes to
    "p6_decoded": "SELECT doc_id, nullif(text, '') AS text FROM documents",
}


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_splits, p3_check, p4_found, p4_report, p6_ids, p6_decoded, p7_containers, p7_fill, p7_check, p8_found, p8_segments, p8_languages, p8_check)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
