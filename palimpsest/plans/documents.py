"""Queries of the rules for documents, columns, records, exports and sessions over the
driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import document as D
from palimpsest.operators import columns, elements, export, records, regions, sessions
from palimpsest.plans.queries import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


WS, NOT_WS = D.WS, D.NOT_WS
#: Macros of the oracle: stripped text, and how often a pattern matches.
STRIP = f"regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g')"
COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{sql_text(p)}'))"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents: doc_id, nth from 0, line."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("nth", "line"))


LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


@query(f"""WITH s AS (SELECT doc_id, {STRIP} AS s, doc_id % 3 * 200000.0 AS area FROM documents), m AS (SELECT *, length(s) AS n FROM s),
r AS (SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 10 THEN 'too_few_chars' WHEN {COUNT("s", "�")} * 1.0 / n > 0.01 THEN 'fffd_ratio'
WHEN {COUNT("s", "[" + chr(92) + "x00-" + chr(92) + "x08" + chr(92) + "x0b" + chr(92) + "x0c" + chr(92) + "x0e-" + chr(92) + "x1f]")} * 1.0 / n > 0.02 THEN 'nonprint_ratio'
WHEN ({COUNT("s", "[�□]")} + 3 * {COUNT("s", "[?][?][?]")}) * 1.0 / n > 0.03 THEN 'suspicious_glyph_loss'
WHEN area > 0 AND n / greatest(area / 1000.0, 1.0) > 15 THEN 'implausible_text_density' END AS reason FROM m)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'trusted' WHEN reason = 'empty' THEN 'absent' ELSE 'rejected' END AS status, coalesce(reason, '') AS reason FROM r""")
def text_layer_trust(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").withColumn("reason", D.layer_reason(F.coalesce("text", F.lit("")), F.col("doc_id") % 3 * 200000.0))
    return x.select("doc_id", D.layer_status(F.col("reason")).alias("status"), F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"""SELECT doc_id, CASE WHEN length({STRIP}) = 0 THEN 'empty extracted text' WHEN ({COUNT("text", "[�□]")} + 3 * {COUNT("text", "[?][?][?]")}) * 1.0 / length({STRIP}) > 0.03 THEN 'suspicious glyph loss' ELSE '' END AS reason FROM documents""")
def searchable_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(D.searchable_reason(F.coalesce("text", F.lit(""))), F.lit("")).alias("reason"))


KINDS = f"""{LINES}, t AS (SELECT doc_id, line, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS s FROM lines),
u AS (SELECT *, length(s) AS n, regexp_replace(s, '[^a-zA-ZÀ-ÿ]', '', 'g') AS latin, {COUNT("s", NOT_WS + "+")} AS n_words, {COUNT("s", chr(92) + "p{L}")} AS letters, {COUNT("s", chr(92) + "p{Nd}")} AS digits FROM t),
h AS (SELECT *, CASE WHEN n < 3 OR n > 120 OR letters < 2 THEN NULL WHEN regexp_matches(s, '{sql_text(D.HEADING1)}') AND n < 80 THEN 'heading1'
WHEN regexp_matches(latin, '[A-ZÀ-ÖØ-Þ]') AND NOT regexp_matches(latin, '[a-zß-öø-ÿ]') AND length(latin) >= 5 AND n < 60 AND n_words <= 5 THEN 'heading2'
WHEN regexp_matches(s, '{sql_text(D.HEADING3)}') AND n < 60 THEN 'heading3' END AS heading,
NOT (n = 0 OR regexp_matches(s, '{sql_text(D.LABEL)}') OR (contains(s, ':') AND NOT suffix(s, ':')) OR (digits > 0 AND digits * 1.0 / greatest(letters + digits, 1) >= 0.1) OR (n_words = 1 AND letters > 0 AND NOT regexp_matches(s, '(?i)[AEIOUY]'))) AS plausible FROM u)"""


@query(f"""WITH {KINDS} SELECT doc_id, coalesce(heading, '') AS heading, plausible, count(*) AS n FROM h GROUP BY ALL""")
def heading_kinds(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d).select("doc_id", F.coalesce(D.heading_kind(F.col("line")), F.lit("")).alias("heading"), D.plausible_heading(F.col("line")).alias("plausible"))
    return x.groupBy("doc_id", "heading", "plausible").agg(F.count("*").alias("n"))


@query(f"""WITH {KINDS}, k AS (SELECT doc_id, CASE WHEN {COUNT("line", "[" + D.BOX_DRAWING + "]")} >= 3 OR (contains(line, '{{') AND contains(line, ';') AND contains(line, '}}')) THEN 'preformatted'
WHEN heading IS NOT NULL AND plausible THEN heading WHEN regexp_matches(line, '{sql_text(D.KEY_VALUE)}') AND length(line) < 120 AND NOT regexp_matches(line, '{sql_text(D.CODE)}') THEN 'kv'
WHEN prefix(line, '  ') THEN 'paragraph_indent' ELSE 'paragraph' END AS kind FROM h)
SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL""")
def paragraph_kinds(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return lines(spark, d).select("doc_id", D.paragraph_kind(line, line.startswith("  ")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '{sql_text(D.INLINE_MARKS)}', '\\\\\\1', 'g'), '^([#+-])', '\\\\\\1'), '^([0-9]+\\.)([\\t-\\r ]|$)', '\\\\\\1\\2')), chr(10))) AS escaped FROM documents""")
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    escaped = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), D.markdown_text), "\n")
    return table(spark, d, "documents").select("doc_id", F.md5(escaped.cast("binary")).alias("escaped"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN -p_partkey ELSE CAST(p_partkey AS BIGINT) * p_partkey * (CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 37 WHEN 2 THEN 40000 WHEN 3 THEN 12345678 ELSE 9876543210 END) END AS n FROM part),
t AS (SELECT p_partkey, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS p FROM s), v AS (SELECT *, n / power(1024.0, p) AS x FROM t)
SELECT p_partkey, CASE WHEN n <= 0 THEN '0 B' ELSE CASE WHEN p = 0 OR x >= 100 THEN CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) WHEN x >= 10 THEN printf('%.1f', x) ELSE printf('%.2f', x) END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] END AS size FROM v""")
def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    # 64 bits do not hold the products of keys over 30,000
    k, c = F.col("p_partkey").cast("decimal(19,0)"), F.col("p_size") % 5
    scale = F.when(c == 0, 1).when(c == 1, 37).when(c == 2, 40000).when(c == 3, 12345678).otherwise(9876543210)
    return table(spark, d, "part").select("p_partkey", D.file_size(F.when(k % 50 == 0, -k).otherwise(k * k * scale)).alias("size"))


@query()
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text against the next: all rates of normal forms."""
    b = table(spark, d, "benchmark").select("item_id", D.normal_form(F.col("text")).alias("t"))
    x = b.withColumnRenamed("t", "got").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("want")), "item_id")
    got, want = F.col("got"), F.col("want")
    rates = {"cer": D.char_error(got, want), "wer": D.word_error(got, want), "likeness": D.likeness(got, want), "sorted_cer": D.char_error(D.sorted_form(got), D.sorted_form(want))}
    return x.select("item_id", *(F.round(c, 6).alias(n) for n, c in rates.items()))


@query()
def micro_error(spark: SparkSession, d: str) -> DataFrame:
    """All edits of all texts for each expected character."""
    b = table(spark, d, "benchmark").select("item_id", D.normal_form(F.col("text")).alias("t"))
    x = b.withColumnRenamed("t", "got").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("want")), "item_id")
    return x.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.levenshtein("got", "want")), F.lit(0)) / F.greatest(F.coalesce(F.sum(F.length("want")), F.lit(0)), F.lit(1)), 6).alias("micro_cer"))


def page_words(spark: SparkSession, d: str) -> DataFrame:
    """A page for each supplier, two columns of words on most."""
    k = F.col("l_partkey")
    x = F.when(F.col("l_suppkey") % 3 == 0, k % 800).otherwise(F.col("l_orderkey") % 2 * 420 + k * 7 % 300)
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), x.alias("x"), (F.col("l_quantity").cast("bigint") + 10).alias("w"))


BINS = """w AS (SELECT l_suppkey AS page, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 800 ELSE l_orderkey % 2 * 420 + l_partkey * 7 % 300 END AS x, CAST(l_quantity AS BIGINT) + 10 AS w FROM lineitem),
e AS (SELECT page, min(x) AS l, max(x + w) AS r, count(*) AS nw, CAST(greatest(1, floor((max(x + w) - min(x)) / 10.0)) AS INTEGER) AS nb FROM w GROUP BY page),
a AS (SELECT page, nb, unnest(range(0, nb)) AS bin FROM e),
c AS (SELECT page, unnest(range(CAST(greatest(0, floor((x - l) / 10.0)) AS BIGINT), CAST(least(nb - 1, floor((x + w - l) / 10.0)) AS BIGINT) + 1)) AS bin FROM w JOIN e USING (page)),
b AS (SELECT a.page, a.bin, a.nb, count(c.bin) AS n FROM a LEFT JOIN c ON a.page = c.page AND a.bin = c.bin GROUP BY ALL)"""


@query(f"""WITH {BINS} SELECT page, bin, n, nb AS n_bins FROM b""")
def coverage_bins(spark: SparkSession, d: str) -> DataFrame:
    return columns.coverage(page_words(spark, d), ["page"])


@query(f"""WITH {BINS}, p AS (SELECT page, max(n) FILTER (bin < floor(nb * 0.25)) AS lp, max(n) FILTER (bin >= floor(nb * 0.75)) AS rp, min(n) FILTER (bin >= floor(nb * 0.25) AND bin < floor(nb * 0.75)) AS mi FROM b GROUP BY page),
q AS (SELECT b.page, bin, bin - row_number() OVER (PARTITION BY b.page ORDER BY bin) AS run FROM b JOIN p USING (page) WHERE lp > 0 AND rp > 0 AND mi <= (lp + rp) / 2.0 * 0.3 AND bin >= floor(nb * 0.25) AND bin < floor(nb * 0.75) AND n <= (lp + rp) / 2.0 * 0.3),
g AS (SELECT page, min(bin) AS f, max(bin) AS t FROM q GROUP BY page, run), v AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY t - f DESC, f) AS k FROM g),
s AS (SELECT e.page, l, r, nw, l + (f + t + 1) / 2.0 * 10 AS split_x FROM v JOIN e USING (page) WHERE k = 1 AND (t - f + 1) * 10 >= 30 AND nw >= 20 AND r - l >= 200),
o AS (SELECT s.page, l, r, nw, split_x, count(*) FILTER (x + w / 2.0 < split_x) AS le FROM s JOIN w USING (page) GROUP BY ALL)
SELECT page, CAST(l AS DOUBLE) AS page_left, CAST(split_x AS DOUBLE) AS split_x, CAST(r AS DOUBLE) AS page_right FROM o WHERE least(le, nw - le) * 1.0 / nw >= 0.3""")
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    return columns.page_columns(page_words(spark, d), ["page"])


@query()
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the pages of words that orders make."""
    from palimpsest.plans.queries import numbered_words

    words = numbered_words(spark, d).withColumn("text", F.concat(F.lit("w"), F.col("word").cast("string")))
    return columns.text_lines(words, ["page"])


RECORDS = """r AS (SELECT l_returnflag || l_linestatus AS benchmark_profile, CAST(l_suppkey % 7 AS VARCHAR) AS dataset, CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS page_index, CASE WHEN l_partkey % 11 = 0 THEN 'failed' WHEN l_partkey % 11 = 1 THEN '' END AS failure_reason,
CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 5 > 1 END AS text_layer_ok, CASE WHEN l_partkey % 13 > 0 THEN l_discount END AS char_error_rate, l_tax AS word_error_rate, CASE WHEN l_partkey % 17 > 0 THEN CAST(l_partkey % 23 AS BIGINT) END AS char_edit_distance,
CAST(l_quantity AS BIGINT) AS expected_char_count, CAST(l_partkey % 3 AS BIGINT) AS word_edit_distance, CASE WHEN l_partkey % 19 > 0 THEN CAST(l_quantity AS BIGINT) END AS expected_word_count, 1 - l_tax AS levenshtein_ratio, CASE WHEN l_partkey % 7 > 0 THEN l_quantity END AS end_to_end_seconds,
l_extendedprice AS peak_rss_mb, CAST(l_partkey AS BIGINT) AS pdf_output_size_bytes, CAST(l_partkey % 4 AS BIGINT) AS ocr_box_count, CAST(l_partkey % 6 AS BIGINT) AS pages_with_zero_boxes FROM lineitem)"""


def lineitem_records(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark records with gaps, one for each line item."""
    k, n = F.col("l_partkey"), lambda c: c.cast("bigint")
    return table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("benchmark_profile"),
        (F.col("l_suppkey") % 7).cast("string").alias("dataset"),
        F.col("l_orderkey").cast("string").alias("id"),
        F.col("l_linenumber").alias("page_index"),
        F.when(k % 11 == 0, "failed").when(k % 11 == 1, "").alias("failure_reason"),
        F.when(k % 5 > 0, k % 5 > 1).alias("text_layer_ok"),
        F.when(k % 13 > 0, F.col("l_discount")).alias("char_error_rate"),
        F.col("l_tax").alias("word_error_rate"),
        F.when(k % 17 > 0, n(k % 23)).alias("char_edit_distance"),
        n(F.col("l_quantity")).alias("expected_char_count"),
        n(k % 3).alias("word_edit_distance"),
        F.when(k % 19 > 0, n(F.col("l_quantity"))).alias("expected_word_count"),
        (1 - F.col("l_tax")).alias("levenshtein_ratio"),
        F.when(k % 7 > 0, F.col("l_quantity")).alias("end_to_end_seconds"),
        F.col("l_extendedprice").alias("peak_rss_mb"),
        n(k).alias("pdf_output_size_bytes"),
        n(k % 4).alias("ocr_box_count"),
        n(k % 6).alias("pages_with_zero_boxes"),
    )


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


@query(f"""WITH {RECORDS}, s AS (SELECT benchmark_profile, list_sort(list(end_to_end_seconds) FILTER (end_to_end_seconds IS NOT NULL)) AS q FROM r GROUP BY 1)
SELECT benchmark_profile, count(*) AS pages, count(*) FILTER (coalesce(failure_reason, '') = '') AS successful_pages, count(*) FILTER (failure_reason <> '') AS failed_pages, count(*) FILTER (text_layer_ok) AS text_layer_ok_pages,
round(avg(char_error_rate), 6) AS mean_cer, round(sum(char_edit_distance) FILTER (expected_char_count IS NOT NULL) / CAST(sum(expected_char_count) FILTER (char_edit_distance IS NOT NULL) AS DOUBLE), 6) AS micro_cer, round(avg(word_error_rate), 6) AS mean_wer,
round(sum(word_edit_distance) FILTER (expected_word_count IS NOT NULL) / CAST(sum(expected_word_count) AS DOUBLE), 6) AS micro_wer, round(avg(levenshtein_ratio), 6) AS mean_levenshtein_ratio, round(avg(end_to_end_seconds), 6) AS mean_seconds_page, max(peak_rss_mb) AS peak_rss_mb,
round(avg(pdf_output_size_bytes), 6) AS mean_pdf_size_bytes, round(count(*) FILTER (text_layer_ok) * 100.0 / count(*), 6) AS text_layer_ok_percent, median(end_to_end_seconds) AS median_seconds_page, any_value(q[CAST(round_even((len(q) - 1) * 0.95, 0) AS INTEGER) + 1]) AS p95_seconds_page
FROM r JOIN s USING (benchmark_profile) GROUP BY 1""")
def records_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(records.summary(lineitem_records(spark, d), ["benchmark_profile"]))


@query(f"""WITH {RECORDS} SELECT dataset, count(*) AS pages, round(avg(char_error_rate), 6) AS mean_cer, round(avg(word_error_rate), 6) AS mean_wer, round(avg(end_to_end_seconds), 6) AS mean_seconds_page, max(peak_rss_mb) AS peak_rss_mb,
round(count(*) FILTER (text_layer_ok) * 1.0 / count(*), 6) AS text_layer_ok, quantile_disc(char_error_rate, 0.95) AS p95_cer, quantile_disc(word_error_rate, 0.95) AS p95_wer, quantile_disc(end_to_end_seconds, 0.95) AS p95_seconds_page, median(end_to_end_seconds) AS median_seconds_page FROM r GROUP BY 1""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(records.comparison_summary(lineitem_records(spark, d), ["dataset"]))


#: Two runs of one record for each order: each lacks some, and some of the second's measures differ.
RUNS = """o AS (SELECT o_orderstatus AS benchmark_profile, o_orderpriority AS dataset, CAST(o_orderkey AS VARCHAR) AS id, 0 AS page_index, o_orderkey AS k, CASE WHEN o_custkey % 13 > 0 THEN o_custkey % 20 / 100.0 END::DOUBLE AS char_error_rate, 1e-1 AS word_error_rate,
CASE WHEN o_custkey % 7 > 0 THEN o_totalprice END AS end_to_end_seconds, 5e2 AS peak_rss_mb, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 > 1 END AS text_layer_ok, o_custkey % 4 AS ocr_box_count, o_custkey % 6 AS pages_with_zero_boxes FROM orders),
a AS (SELECT * FROM o WHERE k % 9 <> 0), b AS (SELECT * REPLACE (char_error_rate + (k % 3 - 1) * 5e-2 AS char_error_rate, end_to_end_seconds * (1 + k % 4 * 15e-2) AS end_to_end_seconds, text_layer_ok AND k % 6 <> 0 AS text_layer_ok,
CASE WHEN k % 5 = 0 THEN 0 ELSE ocr_box_count END AS ocr_box_count, pages_with_zero_boxes + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS pages_with_zero_boxes) FROM o WHERE k % 8 <> 0)"""


def two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, k = F.col("o_custkey"), F.col("k")
    o = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("benchmark_profile"),
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.lit(0).alias("page_index"),
        F.col("o_orderkey").alias("k"),
        F.when(c % 13 > 0, c % 20 / 100).alias("char_error_rate"),
        F.lit(0.1).alias("word_error_rate"),
        F.when(c % 7 > 0, F.col("o_totalprice")).alias("end_to_end_seconds"),
        F.lit(500.0).alias("peak_rss_mb"),
        F.when(c % 5 > 0, c % 5 > 1).alias("text_layer_ok"),
        (c % 4).alias("ocr_box_count"),
        (c % 6).alias("pages_with_zero_boxes"),
    )
    b = o.filter(k % 8 != 0).withColumns({
        "char_error_rate": F.col("char_error_rate") + (k % 3 - 1) * 0.05,
        "end_to_end_seconds": F.col("end_to_end_seconds") * (1 + k % 4 * 0.15),
        "text_layer_ok": F.col("text_layer_ok") & (k % 6 != 0),
        "ocr_box_count": F.when(k % 5 == 0, 0).otherwise(F.col("ocr_box_count")),
        "pages_with_zero_boxes": F.col("pages_with_zero_boxes") + F.when(k % 10 == 0, 1).otherwise(0),
    })
    return o.filter(k % 9 != 0), b


GATE = f"""{RUNS}, m AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'candidate' WHEN b.id IS NULL THEN 'baseline' ELSE 'both' END AS side,
CASE WHEN a.char_error_rate >= 0 THEN a.char_error_rate END AS ac, CASE WHEN b.char_error_rate >= 0 THEN b.char_error_rate END AS bc, CASE WHEN a.end_to_end_seconds > 0 THEN a.end_to_end_seconds END AS asec, CASE WHEN b.end_to_end_seconds > 0 THEN b.end_to_end_seconds END AS bsec,
a.text_layer_ok AS ok1, b.text_layer_ok AS ok2, a.ocr_box_count AS x1, b.ocr_box_count AS x2, a.pages_with_zero_boxes AS z1, b.pages_with_zero_boxes AS z2
FROM a FULL JOIN b ON a.id = b.id AND a.benchmark_profile = b.benchmark_profile AND a.dataset = b.dataset),
g AS (SELECT id, side, CASE WHEN side = 'both' THEN concat_ws(',', CASE WHEN ac IS NULL THEN 'char_error_rate' END, CASE WHEN asec IS NULL THEN 'end_to_end_seconds' END, CASE WHEN ok1 IS NULL THEN 'text_layer_ok' END) ELSE '' END AS missing_base,
CASE WHEN side = 'both' THEN concat_ws(',', CASE WHEN bc IS NULL THEN 'char_error_rate' END, CASE WHEN bsec IS NULL THEN 'end_to_end_seconds' END, CASE WHEN ok2 IS NULL THEN 'text_layer_ok' END) ELSE '' END AS missing_new,
CASE WHEN side = 'both' THEN concat_ws(',', CASE WHEN (bc - ac) / greatest(abs(ac), 1e-9) > 0.01 THEN 'char_error_rate' END, CASE WHEN (bsec - asec) / greatest(abs(asec), 1e-9) > 0.2 THEN 'end_to_end_seconds' END, CASE WHEN ok1 AND NOT ok2 THEN 'text_layer_ok' END,
CASE WHEN x1 <> 0 AND x2 <= 0 THEN 'ocr_box_count_zero' END, CASE WHEN z2 - z1 > 0 THEN 'pages_with_zero_boxes' END) ELSE '' END AS regressions FROM m)"""


@query(f"""WITH {GATE} SELECT * FROM g""")
def record_gate(spark: SparkSession, d: str) -> DataFrame:
    x = records.compared(*two_runs(spark, d))
    return x.select("id", "side", *(F.array_join(c, ",").alias(c) for c in ("missing_base", "missing_new", "regressions")))


@query(f"""WITH {GATE} SELECT count(*) FILTER (side <> 'candidate') AS baseline_records, count(*) FILTER (side <> 'baseline') AS candidate_records, count(*) FILTER (side = 'baseline') AS baseline_only, count(*) FILTER (side = 'candidate') AS candidate_only,
count(*) FILTER (missing_base <> '') + count(*) FILTER (missing_new <> '') AS metric_missing, CAST(0 AS BIGINT) AS settings_mismatch, count(*) FILTER (regressions <> '') AS record_regressions, false AS comparable, false AS passes FROM g""")
def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return records.verdict(records.compared(*two_runs(spark, d)))


def dealt_documents(spark: SparkSession, d: str) -> DataFrame:
    """doc and text, dealt by doc: what is made of a document stays in its task, where its
    rows would be many times its text. Every query moves the texts once."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text").repartition("doc")


def text_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents set in type, 45 lines a page: doc, page, at (line of the page), c (column of
    the page), x and words of each line, gap between words. A paragraph is a line of the text
    and an empty line follows it; lines hold 12 words. Every fourth paragraph is set with wide
    gaps, some begin or stand indented, and every tenth document has two columns with lines
    of 6 words."""
    paragraph = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "_line")
    x = dealt_documents(spark, d).select("doc", paragraph)
    x = x.withColumn("words", F.filter(F.split("_line", " "), lambda t: t != ""))
    two = F.col("doc") % 10 == 0
    x = x.withColumns({"_wrap": F.when(two, 6).otherwise(12), "_two": two})
    x = x.withColumn("_rows", F.ceil(F.size("words") / F.col("_wrap")).cast("int") + 1)
    before = Window.partitionBy("doc").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_row", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    row = F.transform(F.sequence(F.lit(0), F.col("_rows") - 2), lambda r: F.slice("words", r * F.col("_wrap") + 1, F.col("_wrap")))
    x = x.filter(F.size("words") > 0).select("doc", "p", "_two", "_row", F.posexplode(row).alias("r", "words"))
    p, at = F.col("p"), F.col("_row") + F.col("r")
    shift = F.when((p % 5 == 2) & (F.col("r") == 0), 30).when(p % 7 == 3, 100).otherwise(0)
    place = F.when(F.col("_two"), F.floor(at / 90)).otherwise(F.floor(at / 45)).cast("int")
    column = F.when(F.col("_two"), F.floor(at % 90 / 45)).otherwise(0).cast("int")
    return x.select("doc", place.alias("page"), (at % 45).cast("int").alias("at"), column.alias("c"), (column * 560 + shift).alias("x"), F.when(p % 4 == 1, 46).otherwise(6).alias("gap"), "words")


def text_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of those lines with boxes."""
    left = F.transform("words", lambda _, k: F.col("x") + F.aggregate(F.slice("words", 1, k), F.lit(0), lambda s, v: s + F.length(v) * 6) + k * F.col("gap"))
    x = text_rows(spark, d).select("doc", "page", "at", "c", F.posexplode(F.arrays_zip(left.alias("x"), F.col("words").alias("text"))).alias("k", "v"))
    return x.select("doc", "page", ((F.col("c") * 45 + F.col("at")) * 100 + F.col("k")).cast("long").alias("word"), F.col("v.x").cast("double").alias("x"), (F.col("at") * 14 + F.col("k") % 3).cast("double").alias("y"), (F.length("v.text") * 6).cast("double").alias("w"), F.lit(10.0).alias("h"), F.col("v.text").alias("text"))


def text_regions(spark: SparkSession, d: str) -> DataFrame:
    """Recognised regions of those pages: whole lines, or words where gaps are wide."""
    wide = F.col("gap") > 6
    parts = F.when(wide, F.col("words")).otherwise(F.array(F.array_join("words", " ")))
    x = text_rows(spark, d).select("doc", "page", "at", "c", "x", "gap", parts.alias("parts"))
    left = F.transform("parts", lambda _, k: F.col("x") + F.aggregate(F.slice("parts", 1, k), F.lit(0), lambda s, v: s + F.length(v) * 6) + k * F.col("gap"))
    x = x.select("doc", "page", "at", "c", F.posexplode(F.arrays_zip(left.alias("x"), F.col("parts").alias("text"))).alias("k", "v"))
    y, k = F.col("at") * 14, F.col("k")
    return x.select("doc", "page", ((F.col("c") * 45 + F.col("at")) * 100 + k).cast("long").alias("region"), F.col("v.x").cast("double").alias("x0"), (y + k % 3).cast("double").alias("y0"), (F.col("v.x") + F.length("v.text") * 6).cast("double").alias("x1"), (y + 12 + (F.col("at") + k) % 5).cast("double").alias("y1"), F.col("v.text").alias("text"))


def text_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of those documents: up to the last line, blank ones too."""
    x = dealt_documents(spark, d).select("doc", F.split(F.coalesce("text", F.lit("")), "\n").alias("_lines"))
    wrap, rows = F.when(F.col("doc") % 10 == 0, 6).otherwise(12), F.when(F.col("doc") % 10 == 0, 90).otherwise(45)
    n = F.aggregate("_lines", F.lit(0).cast("bigint"), lambda s, v: s + F.ceil(F.size(F.filter(F.split(v, " "), lambda t: t != "")) / wrap) + 1)
    return x.select("doc", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / rows).cast("int"))).alias("page"))


@query()
def page_elements(spark: SparkSession, d: str) -> DataFrame:
    return elements.page_elements(text_words(spark, d))


@query()
def page_tables(spark: SparkSession, d: str) -> DataFrame:
    return elements.table_cells(elements.page_elements(text_words(spark, d)))


@query()
def region_text(spark: SparkSession, d: str) -> DataFrame:
    x = text_regions(spark, d)
    return regions.region_text(x, x.groupBy("doc", "page").agg(F.greatest(F.max("x1"), F.lit(600.0)).alias("page_width")))


@query()
def region_grids(spark: SparkSession, d: str) -> DataFrame:
    x = text_regions(spark, d)
    width = F.greatest(F.max("x1").over(Window.partitionBy("doc", "page")), F.lit(600.0))
    return regions.page_grids(x.withColumn("page_width", width))


@query()
def baseline_lines(spark: SparkSession, d: str) -> DataFrame:
    x = text_regions(spark, d).select("doc", "page", "region", (700 - F.col("y0")).alias("y"), (F.col("y1") - F.col("y0")).alias("height"), "text")
    return regions.baseline_lines(x)


@query()
def regions_apart(spark: SparkSession, d: str) -> DataFrame:
    return regions.apart(text_regions(spark, d)).select("doc", "page", "region", "y0", "y1")


@query()
def text_export(spark: SparkSession, d: str) -> DataFrame:
    pages = text_pages(spark, d)
    return export.as_text(export.across_pages(elements.page_elements(text_words(spark, d)), pages), pages)


@query()
def markdown_export(spark: SparkSession, d: str) -> DataFrame:
    pages = text_pages(spark, d)
    return export.as_markdown(export.across_pages(elements.page_elements(text_words(spark, d)), pages), pages)


#: Sessions of files: a supplier's parts, and an event for each line item.
EVENTS = """q AS (SELECT DISTINCT l_suppkey AS session, l_partkey AS file FROM lineitem WHERE l_partkey % 4 <> 0),
e AS (SELECT l_suppkey AS session, l_partkey AS file, l_orderkey * 10 + l_linenumber AS t, CASE WHEN l_orderkey % 5000 = 0 THEN 'discard' WHEN l_linenumber = 7 THEN 'close' WHEN l_returnflag = 'R' THEN 'fail' ELSE 'complete' END AS event, l_shipdate::VARCHAR AS day FROM lineitem),
d AS (SELECT q.session, q.file, min(t) FILTER (event IN ('complete', 'fail')) AS done FROM q LEFT JOIN e ON q.session = e.session AND q.file = e.file GROUP BY 1, 2),
y AS (SELECT session, max(done) AS ready FROM d GROUP BY 1 HAVING count(*) = count(done)), c AS (SELECT e.session, min(t) AS closed_at FROM e JOIN y ON e.session = y.session AND t > ready WHERE event = 'close' GROUP BY 1),
l AS (SELECT e.session, e.file, arg_max(event, t) AS event FROM e LEFT JOIN c ON e.session = c.session WHERE event IN ('complete', 'fail') AND (closed_at IS NULL OR t < closed_at) GROUP BY 1, 2),
f AS (SELECT q.session, q.file, CASE event WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'pending' END AS state FROM q LEFT JOIN l ON q.session = l.session AND q.file = l.file WHERE q.session NOT IN (SELECT session FROM e WHERE event = 'discard'))"""


def session_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_orderkey", "l_linenumber", "l_returnflag")
    event = F.when(F.col("l_orderkey") % 5000 == 0, "discard").when(F.col("l_linenumber") == 7, "close").when(F.col("l_returnflag") == "R", "fail").otherwise("complete")
    return x.filter("file % 4 <> 0").select("session", "file").distinct(), x.select("session", "file", "at", event.alias("event"), F.lit("").alias("detail"))


@query(f"""WITH {EVENTS} SELECT session, file, state FROM f""")
def file_states(spark: SparkSession, d: str) -> DataFrame:
    return sessions.final_states(*session_events(spark, d)).select("session", "file", "state")


@query(f"""WITH {EVENTS} SELECT session, count(*) AS n, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'pending') AS pending, session IN (SELECT session FROM c) AS is_complete FROM f GROUP BY session""")
def session_states(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_states(*session_events(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
