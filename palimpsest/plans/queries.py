"""Registered queries over the driver's tables, and their SQL for the oracle. Boxes
and pages are derived from columns with integer arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as T
from palimpsest.functions.geometry import Box
from palimpsest.operators import benchmarks, jobs, layout, pages, ranks, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, d: str) -> DataFrame:
    """A page for each order, a word for each of its lines."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"),
        F.col("l_linenumber").cast("bigint").alias("word"),
        (F.col("l_partkey") % 800).alias("x"),
        (F.col("l_suppkey") * 7 % 90).alias("y"),
        (F.col("l_quantity").cast("bigint") + 20).alias("w"),
        (F.col("l_linenumber").cast("bigint") * 3 + 10).alias("h"),
    )


WORDS = """words AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS word, l_partkey % 800 AS x, l_suppkey * 7 % 90 AS y,
  CAST(l_quantity AS BIGINT) + 20 AS w, CAST(l_linenumber AS BIGINT) * 3 + 10 AS h FROM lineitem),
ids AS (SELECT page, x, y, w, h, row_number() OVER (PARTITION BY page ORDER BY word, x, y, w) AS word FROM words)"""


def numbered_words(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("page").orderBy("word", "x", "y", "w")
    return words(spark, d).withColumn("word", F.row_number().over(order).cast("bigint"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return numbered_words(spark, d).select("page", F.col("word").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w") * 4).alias("x1"), (F.col("y") + F.col("h") * 2).alias("y1"))


BOXES = WORDS + """, boxes AS (SELECT page, word AS id, x AS x0, y AS y0, x + w * 4 AS x1, y + h * 2 AS y1 FROM ids)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """A document for each conversation, a page for each turn."""
    x = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("turn", "role", "text")).cast("long"))


TURNS = """pages AS (SELECT conv_id AS doc, turn, role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) AS pos FROM conversations)"""


@query(f"""WITH {WORDS}, m AS (SELECT *, CASE WHEN x - lag(x + w) OVER o > 15 OR lag(x) OVER o IS NULL THEN 1 ELSE 0 END AS f FROM ids WINDOW o AS (PARTITION BY page ORDER BY x, word)),
g AS (SELECT *, CAST(sum(f) OVER (PARTITION BY page ORDER BY x, word ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS grp FROM m)
SELECT page, grp, count(*) AS n_words, min(x) AS x0, max(x + w) AS x1 FROM g GROUP BY page, grp""")
def word_groups(spark: SparkSession, d: str) -> DataFrame:
    return layout.word_groups(numbered_words(spark, d), ["page"])


@query()
def line_group_running_mean(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines(numbered_words(spark, d), ["page"])


@query(f"""WITH {WORDS} SELECT page, unnest(range(CAST(floor(x / 10) AS BIGINT), CAST(floor((x + w) / 10) AS BIGINT) + 1)) AS bin, count(*) AS n FROM ids GROUP BY page, bin""")
def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    return layout.coverage(numbered_words(spark, d), ["page"])


@query("""WITH b AS (SELECT CAST(l_suppkey AS BIGINT) AS page, CAST(l_partkey % 50 AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, bin - row_number() OVER (PARTITION BY page ORDER BY bin) AS run FROM b WHERE n < 40),
g AS (SELECT page, min(bin) AS f, count(*) AS c FROM r GROUP BY page, run),
k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY c DESC, f) AS r FROM g)
SELECT page, f * 10 AS x0, (f + c) * 10 AS x1 FROM k WHERE r = 1 AND c >= 3""")
def valley_run(spark: SparkSession, d: str) -> DataFrame:
    bins = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("bigint").alias("page"), (F.col("l_partkey") % 50).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return layout.valley(bins, ["page"], 40)


@query(f"""WITH {BOXES}, s AS (SELECT page, x0, x0 + 30 AS x1 FROM boxes),
m AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS isl FROM m),
j AS (SELECT page, isl, min(x0) AS x0, max(x1) AS x1 FROM i GROUP BY page, isl),
n AS (SELECT page, x1 AS gap0, lead(x0) OVER (PARTITION BY page ORDER BY x0) AS gap1 FROM j),
f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap1 - gap0 DESC, gap0) AS r FROM n WHERE gap1 IS NOT NULL AND gap1 - gap0 >= 30 AND (gap0 + gap1) / 2.0 BETWEEN 280 AND 520),
c AS (SELECT s.page, gap0, gap1, count(*) FILTER ((x0 + x1) / 2.0 <= gap0) AS "left", count(*) FILTER ((x0 + x1) / 2.0 >= gap1) AS "right", count(*) AS n FROM s JOIN f ON s.page = f.page AND r = 1 GROUP BY ALL)
SELECT page, gap0, gap1, "left", "right" FROM c WHERE "left" >= 2 AND "right" >= 2 AND n >= 4""")
def spread_gap(spark: SparkSession, d: str) -> DataFrame:
    spans = boxes(spark, d).select("page", "x0", (F.col("x0") + 30).alias("x1"))
    return layout.spread_gap(spans, ["page"], 800, 30)


@query(f"""WITH {TURNS}, s AS (SELECT *, role = 'user' AS split FROM pages)
SELECT doc, pos, CAST(coalesce(sum(CASE WHEN split THEN 2 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS logical FROM s""")
def logical_pages(spark: SparkSession, d: str) -> DataFrame:
    x = turns(spark, d).withColumn("split", F.col("role") == "user")
    return layout.logical_pages(x, "doc", "pos").select("doc", "pos", F.col("logical").cast("bigint").alias("logical"))


@query(f"""WITH {TURNS} SELECT doc, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) AS n_parts FROM pages GROUP BY doc""")
def text_assembly(spark: SparkSession, d: str) -> DataFrame:
    return layout.assembled(turns(spark, d), ["doc"], ["pos"], "text", "\n")


OVERLAPS = BOXES + """, p AS (SELECT a.page, a.id AS a_id, b.id AS b_id,
  greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS c,
  (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.id % 2 = 0 AND b.id % 2 = 1)"""


@query(f"""WITH {OVERLAPS} SELECT page, a_id, b_id, round(c * 1.0 / (sa + sb - c), 6) AS iou, c AS common, CAST(least(sa, sb) AS BIGINT) AS smaller FROM p WHERE c > 0""")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = boxes(spark, d)
    a, b = Box.of("a_"), Box.of("b_")
    pairs = spatial.iou_pairs(x.filter("id % 2 = 0"), x.filter("id % 2 = 1"), ["page"])
    return pairs.select("page", "a_id", "b_id", F.round("iou", 6).alias("iou"), a.common(b).alias("common"), F.least(a.area, b.area).alias("smaller"))


@query()
def box_match_greedy(spark: SparkSession, d: str) -> DataFrame:
    x = boxes(spark, d)
    return spatial.matched(spatial.iou_pairs(x.filter("id % 2 = 0"), x.filter("id % 2 = 1"), ["page"]), ["page"], 0.1).withColumn("iou", F.round("iou", 6))


@query("""SELECT p_partkey, list_position(list_transform([5, 18, 27, 44], lambda c: abs(p_size - c)), list_min(list_transform([5, 18, 27, 44], lambda c: abs(p_size - c)))) - 1 AS centre FROM part""")
def nearest_center(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(table(spark, d, "part"), "p_size", [5, 18, 27, 44]).select("p_partkey", "centre")


@query(f"""WITH {TURNS}, s AS (SELECT doc, pos AS block FROM pages WHERE pos % 3 = 1)
SELECT p.doc, p.pos, max(s.block) AS block_start FROM pages p JOIN s ON p.doc = s.doc AND s.block <= p.pos GROUP BY p.doc, p.pos""")
def interval_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = turns(spark, d).select("doc", "pos")
    return spatial.in_blocks(x, x.filter("pos % 3 = 1").withColumnRenamed("pos", "block"), ["doc"], "pos", "block")


@query(f"""WITH {TURNS}, m AS (SELECT doc, pos, CAST(turn % 4 * 90 AS INTEGER) AS rotation, role = 'user' AS deleted FROM pages WHERE pos % 2 = 0)
SELECT p.doc, p.pos, coalesce(m.rotation, 0) AS rotation, coalesce(m.deleted, false) AS deleted, true AS included FROM pages p LEFT JOIN m ON p.doc = m.doc AND p.pos = m.pos""")
def page_mods(spark: SparkSession, d: str) -> DataFrame:
    x = turns(spark, d)
    changes = x.filter("pos % 2 = 0").select("doc", "pos", "turn", (F.col("turn") % 4 * 90).cast("int").alias("rotation"), (F.col("role") == "user").alias("deleted"), F.lit(True).alias("included"))
    return pages.modified(x.select("doc", "pos"), changes)


@query(f"""WITH {TURNS}, k AS (SELECT *, count(*) FILTER (pos % 2 = 1) OVER (PARTITION BY doc) AS left_n FROM pages)
SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY pos) AS pos FROM k WHERE pos % 2 = 1 OR left_n = 0""")
def page_delete(spark: SparkSession, d: str) -> DataFrame:
    x = turns(spark, d).select("doc", "pos", "text")
    return pages.deleted(x, x.filter("pos % 2 = 0"))


@query(f"""WITH {TURNS}, n AS (SELECT doc, max(pos) AS n FROM pages GROUP BY doc), u AS (
  SELECT doc, text, pos * 2.0 AS k FROM pages UNION ALL
  SELECT p.doc, 'new: ' || p.text, CASE WHEN 3 > n THEN (n + 1) * 2.0 - 1 ELSE 5.0 END FROM pages p JOIN n ON p.doc = n.doc WHERE p.pos = 1)
SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY k) AS pos FROM u""")
def page_insert(spark: SparkSession, d: str) -> DataFrame:
    x = turns(spark, d).select("doc", "pos", "text")
    return pages.inserted(x, x.filter("pos = 1").withColumn("text", F.concat(F.lit("new: "), "text")), F.lit(3))


@query(f"""WITH {TURNS}, n AS (SELECT doc, max(pos) AS n FROM pages GROUP BY doc), w AS (
  SELECT doc, unnest(range(1, n + 1)) AS turn, n FROM n), o AS (SELECT doc, turn, n + 1 - turn AS pos FROM w UNION ALL SELECT doc, n + 1, 1 FROM n UNION ALL SELECT doc, n + 2, n + 5 FROM n)
SELECT o.doc, p.text, row_number() OVER (PARTITION BY o.doc ORDER BY o.turn) AS pos FROM o JOIN pages p ON o.doc = p.doc AND o.pos = p.pos""")
def page_reorder(spark: SparkSession, d: str) -> DataFrame:
    x = turns(spark, d).select("doc", "pos", "text")
    n = x.groupBy("doc").agg(F.max("pos").alias("n"))
    wanted = n.select("doc", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.col("n")), lambda t: F.struct(t.cast("long").alias("turn"), (F.col("n") + 1 - t).alias("pos"))), F.array(F.struct((F.col("n") + 1).alias("turn"), F.lit(1).cast("long").alias("pos")), F.struct((F.col("n") + 2).alias("turn"), (F.col("n") + 5).alias("pos"))))).alias("o")).select("doc", "o.*")
    return pages.selected(x, wanted)


@query(f"""WITH {TURNS}, u AS (SELECT 0 AS part, pos, doc % 10 AS doc, text, doc AS src FROM pages WHERE doc < 10 UNION ALL SELECT 1, pos, doc % 10, text, doc FROM pages WHERE doc >= 10 AND doc < 20)
SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY part, pos) AS pos FROM u""")
def page_merge(spark: SparkSession, d: str) -> DataFrame:
    x = turns(spark, d).select("doc", "pos", "text")
    part = lambda a, b: x.filter((F.col("doc") >= a) & (F.col("doc") < b)).withColumn("doc", F.col("doc") % 10)
    return pages.merged([part(0, 10), part(10, 20)])


@query(f"""WITH {TURNS}, u AS (SELECT doc & 1 AS part, pos, doc >> 1 AS doc, text FROM pages)
SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY part, pos) AS pos FROM u""")
def page_merge_all(spark: SparkSession, d: str) -> DataFrame:
    """All conversations: each of even id, then the one of the next id."""
    x = turns(spark, d).select(F.shiftright("doc", 1).alias("doc"), "pos", "text", (F.col("doc").bitwiseAND(1) == 1).alias("odd"))
    return pages.merged([x.filter("odd IS DISTINCT FROM true").drop("odd"), x.filter("odd").drop("odd")])


@query(f"""WITH {TURNS} SELECT doc, pos, CASE WHEN pos % 2 = 1 THEN (turn * 90 % 360 + 270) % 360 ELSE turn * 90 % 360 END AS rotation FROM pages""")
def page_rotate(spark: SparkSession, d: str) -> DataFrame:
    x = turns(spark, d).select("doc", "pos", (F.col("turn") * 90 % 360).alias("rotation"))
    listed = x.filter("pos % 2 = 1").select("doc", "pos")
    return pages.rotated(x, listed.unionByName(listed), -90)


@query(f"""WITH {TURNS} SELECT doc, pos, (pos - 1) // 3 AS part FROM pages""")
def fixed_split(spark: SparkSession, d: str) -> DataFrame:
    return pages.fixed_parts(turns(spark, d).select("doc", "pos"), 3)


@query(f"""WITH {TURNS}, r AS (SELECT * FROM (VALUES (0, 1, 2), (1, 2, 4), (3, 5, 99)) t(part, a, b)) SELECT doc, pos, part FROM pages JOIN r ON pos BETWEEN a AND b""")
def range_split(spark: SparkSession, d: str) -> DataFrame:
    return pages.range_parts(turns(spark, d).select("doc", "pos"), [(1, 2), (2, 4), (3, 2), (5, 99)])


@query(f"""WITH RECURSIVE {TURNS}, f AS (SELECT doc, pos, CAST(0 AS BIGINT) AS part, CAST(length(text) AS BIGINT) AS s FROM pages WHERE pos = 1
UNION ALL SELECT p.doc, p.pos, CASE WHEN f.s + length(p.text) > 400 THEN f.part + 1 ELSE f.part END, CAST(CASE WHEN f.s + length(p.text) > 400 THEN length(p.text) ELSE f.s + length(p.text) END AS BIGINT)
FROM f JOIN pages p ON p.doc = f.doc AND p.pos = f.pos + 1) SELECT doc, pos, part FROM f""")
def size_split(spark: SparkSession, d: str) -> DataFrame:
    return pages.size_parts(turns(spark, d).withColumn("size", F.length("text")), "size", 400)


@query("""SELECT coalesce(nullif(l_returnflag, ''), 'unknown') AS profile, count(*) AS n, count(*) FILTER (l_discount = 0) AS exact, round(avg(l_discount), 6) AS mean_error,
round(median(l_discount), 6) AS median_error, max(l_discount) AS max_error, round(avg(l_quantity), 6) AS mean_seconds, quantile_disc(l_quantity, 0.95) AS p95_seconds FROM lineitem GROUP BY 1""")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumn("profile", F.coalesce(F.nullif("l_returnflag", F.lit("")), F.lit("unknown")))
    return benchmarks.summary(x, ["profile"], "l_discount", "l_quantity")


@query("""WITH r AS (SELECT unnest(['dataset:' || source, 'tag:' || lang]) AS grp, quality, toxic FROM documents JOIN labels USING (doc_id))
SELECT grp, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS bad FROM r GROUP BY grp""")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    x = x.select(F.explode(benchmarks.memberships(F.col("source"), F.array("lang"))).alias("grp"), "quality", "toxic")
    return x.groupBy("grp").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("bad"))


@query("""SELECT o_orderpriority, avg(o_custkey) AS mean, CAST(quantile_disc(o_custkey, 0.5) AS BIGINT) AS median, CAST(quantile_disc(o_custkey, 0.1) AS BIGINT) AS p10, min(o_custkey) AS min, count(o_custkey) AS n FROM orders GROUP BY 1""")
def p95_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    x = benchmarks.confidence(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey")
    return x.withColumns({c: F.col(c).cast("bigint") for c in ("median", "p10")})


@query("""WITH v AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1)
SELECT l_suppkey, q[CAST(round_even((len(q) - 1) * 0.95, 0) AS INTEGER) + 1] AS p95 FROM v""")
def p95_round_index(spark: SparkSession, d: str) -> DataFrame:
    return ranks.at_rank(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", ranks.rounded_index(0.95), "p95")


@query("""WITH s AS (SELECT l_returnflag, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2),
u AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_partkey) AS u, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s)
SELECT l_returnflag, min(l_partkey) AS weighted_median FROM u WHERE u * 2 >= t GROUP BY 1""")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumn("w", F.col("l_quantity").cast("bigint"))
    return benchmarks.weighted_median(x, ["l_returnflag"], "l_partkey", "w")


@query("""WITH s AS (SELECT l_suppkey, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy
FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS w, CAST(l_linenumber AS BIGINT) AS x, l_partkey % 1000 AS y FROM lineitem) GROUP BY 1)
SELECT l_suppkey, round(CAST(w * wxy - wx * wy AS DOUBLE) / CAST(w * wxx - wx * wx AS DOUBLE), 6) AS slope FROM s WHERE w * wxx - wx * wx <> 0""")
def weighted_fit(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.col(c).cast("bigint")
    x = benchmarks.weighted_fit(table(spark, d, "lineitem"), ["l_suppkey"], n("l_linenumber"), F.col("l_partkey") % 1000, n("l_quantity"))
    return x.select("l_suppkey", F.round("slope", 6).alias("slope")).filter("slope IS NOT NULL")


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, o_totalprice * (1 + (o_orderkey % 3 - 1) * 0.3) AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'candidate' WHEN b.o_orderkey IS NULL THEN 'baseline' ELSE 'both' END AS side,
CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND (b.o_totalprice - a.o_totalprice) / greatest(abs(a.o_totalprice), 1e-9) > 0.2 THEN 'o_totalprice' ELSE '' END AS worse
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    new = x.filter("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 3 - 1) * 0.3))
    out = benchmarks.compared(x.filter("o_orderkey % 7 <> 0"), new, ["o_orderkey"], {"o_totalprice": benchmarks.TIME_LIMIT})
    return out.withColumn("worse", F.array_join("worse", ","))


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R') AND o_orderstatus <> 'F'""")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), "o_orderstatus")
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"))
    return jobs.pending(o, done, o.filter("o_orderstatus = 'F'")).select(F.col("file").alias("o_orderkey"))


@query("""WITH f AS (SELECT o_custkey AS session, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'open' END AS state FROM orders)
SELECT session, count(*) AS n, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'open') AS pending, count(*) FILTER (state = 'open') = 0 AS complete FROM f GROUP BY session""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("open")
    return jobs.sessions(table(spark, d, "orders").select(F.col("o_custkey").alias("session"), state.alias("state")))


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def history_top100(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(table(spark, d, "events"), "ts", "event_id").select("event_id", "user_id", "event_type")


@query("""WITH r AS (SELECT doc_id, md5(coalesce(text, '')) AS identity, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents) SELECT doc_id, identity FROM r WHERE r = 1""")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("identity"))
    return jobs.first_of(x, "identity", "doc_id")


@query(f"""WITH {TURNS} SELECT a.doc, a.pos, CASE WHEN length(b.text) > length(a.text) THEN b.text ELSE a.text END AS text FROM pages a JOIN pages b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.pos % 2 = 1""")
def better_of_two(spark: SparkSession, d: str) -> DataFrame:
    x = turns(spark, d).select("doc", "pos", F.struct("text", F.lit(0.5).alias("score")).alias("r"))
    second = x.select("doc", (F.col("pos") - 1).alias("pos"), F.col("r").alias("s"))
    return x.filter("pos % 2 = 1").join(second, ["doc", "pos"]).select("doc", "pos", jobs.better(F.col("r"), F.col("s"))["text"].alias("text"))


@query(f"""WITH {TURNS}, s AS (SELECT doc, pos, text, length(text) // 200 AS n, pos * 7 % 5 / 10.0 AS score FROM pages)
SELECT a.doc, a.pos, CASE WHEN b.n > a.n OR b.n = a.n AND b.score > a.score THEN 'second' ELSE 'first' END AS reading FROM s a JOIN s b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL""")
def better_reading(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the next by length in steps of 200, where many tie, then by score."""
    text = F.repeat(F.lit("x"), F.floor(F.length("text") / 200).cast("int"))
    x = turns(spark, d).filter("text IS NOT NULL").select("doc", "pos", text.alias("text"), (F.col("pos") * 7 % 5 / 10.0).alias("score"))
    reading = lambda name: F.struct("text", "score", F.lit(name).alias("reading"))
    second = x.select("doc", (F.col("pos") - 1).alias("pos"), reading("second").alias("s"))
    return x.select("doc", "pos", reading("first").alias("r")).join(second, ["doc", "pos"]).select("doc", "pos", jobs.better(F.col("r"), F.col("s"))["reading"].alias("reading"))


@query(f"""WITH {TURNS}, n AS (SELECT doc, count(*) AS n, count(*) FILTER (pos % 2 = 0 OR doc % 7 = 3) AS g FROM pages GROUP BY doc)
SELECT doc, g > 0 AND g < n AS ok, CASE WHEN g = 0 THEN 'no valid pages' WHEN g >= n THEN 'all pages' END AS reason, CASE WHEN g > 0 AND g < n THEN g ELSE 0 END AS n_deleted, CASE WHEN g > 0 AND g < n THEN n - g ELSE n END AS n_left FROM n""")
def page_deletions(spark: SparkSession, d: str) -> DataFrame:
    """Deleting every second page, all pages of some documents, and a page that none has."""
    x = turns(spark, d).select("doc", "pos")
    return pages.deletions(x, x.filter("pos % 2 = 0 OR doc % 7 = 3").unionByName(x.select("doc", F.lit(0).cast("long").alias("pos"))))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, length(html) - length(replace(html, '<p', '')) AS p_marks FROM pages""")
def html_spans(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "pages")
    return x.select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), (F.length("html") - F.length(F.replace("html", F.lit("<p"), F.lit("")))).cast("bigint").alias("p_marks"))


@query()
def markdown_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.markdown(F.col("text")).cast("binary")).alias("escaped"))


@query("""SELECT doc_id, CASE WHEN n_chars * 37 < 1024 THEN (n_chars * 37) || ' B' WHEN n_chars * 37 < 1048576 THEN printf('%.1f KB', round_even(n_chars * 37 / 1024.0, 1)) ELSE printf('%.1f MB', round_even(n_chars * 37 / 1048576.0, 1)) END AS size FROM documents""")
def human_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.human_size(F.col("n_chars") * 37).alias("size"))


@query("""SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS before_bytes, CAST(sum(strlen(text)) AS BIGINT) AS after_bytes, round((sum(strlen(text)) - sum(n_chars)) * 100.0 / sum(n_chars), 2) AS change_percent,
count(*) FILTER (strlen(text) > n_chars) AS larger, count(*) FILTER (strlen(text) < n_chars) AS smaller, count(*) FILTER (strlen(text) = n_chars) AS same FROM documents""")
def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("n_chars", F.octet_length("text").cast("bigint").alias("bytes"))
    return jobs.batch_stats(x, "n_chars", "bytes")


@query("""SELECT doc_id, md5(coalesce(array_to_string(list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)), chr(10)), '')) AS form FROM documents""")
def sorted_line_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.coalesce(T.sorted_lines(F.col("text")), F.lit("")).cast("binary")).alias("form"))


@query()
def line_class(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(T.line_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN (length(text) - length(replace(replace(text, chr(65533), ''), chr(9633), '')) + 3 * len(regexp_extract_all(text, '\\?\\?\\?'))) * 1.0 / length(text) > 0.03 THEN 'glyph_loss' ELSE 'ok' END AS status FROM documents""")
def searchable_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.searchable(F.col("text")).alias("status"))


@query()
def text_layer_quality(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "text", F.lit(500000.0).alias("area"))
    return T.text_layer(x).select("doc_id", "status", "reason")


@query("""SELECT doc_id, md5(nfc_normalize(text)) AS form FROM documents""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.nfc(F.col("text")).cast("binary")).alias("form"))


@query("""WITH b AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark), p AS (SELECT a.item_id, a.t AS got, c.t AS want FROM b a JOIN b c ON c.item_id = a.item_id + 1)
SELECT item_id, CAST(levenshtein(got, want) AS INTEGER) AS distance, round(levenshtein(got, want) * 1.0 / greatest(length(want), 1), 6) AS cer FROM p""")
def cer_benchmark(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))
    pairs = b.withColumnRenamed("t", "got").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("want")), "item_id")
    return pairs.select("item_id", F.levenshtein("got", "want").alias("distance"), F.round(T.error_rate(F.col("got"), F.col("want")), 6).alias("cer"))


@query()
def cer_whole_texts(spark: SparkSession, d: str) -> DataFrame:
    """As cer_benchmark, but over all code points of the texts in the form in which the
    reference compares them; DuckDB's levenshtein counts bytes."""
    b = table(spark, d, "benchmark").select("item_id", T.metric_text(F.coalesce("text", F.lit(""))).alias("t"))
    pairs = b.withColumnRenamed("t", "got").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("want")), "item_id")
    return pairs.select("item_id", F.levenshtein("got", "want").alias("distance"), F.round(T.error_rate(F.col("got"), F.col("want")), 6).alias("cer"))


@query()
def wer_tokens(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", T.words(F.col("text")).alias("t"))
    pairs = b.withColumnRenamed("t", "got").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("want")), "item_id")
    return pairs.select("item_id", T.token_distance("got", "want").alias("edits"), F.size("want").alias("n_words"))


@query()
def progress_changes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("user_id", "event_id", F.least(F.lit(1.0), F.col("value") / 100).alias("value"))
    return jobs.changed(x, "user_id", "event_id", "value", 0.1)


@query("""SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of files: appended to a table in the shared folder, which is
    then read."""
    import tempfile
    import uuid

    from palimpsest.streaming import ingest

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-stream-")
    place = f"{shared.rstrip('/')}/ingest-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    folder = f"{d}/events.parque[t]"  # a pattern, as the table may be one file or a folder of files
    ingest.ingest(ingest.file_stream(spark, folder, schema), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
