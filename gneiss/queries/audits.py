"""Audit, key-set, ranking and text queries: documents as bundle members, pages' paths, orders as surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import audit, endpoints, inference, summaries
from gneiss.queries.common import Registry, r, result
from gneiss.sources.documents import number_or_null
from gneiss.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

MEMBERS = "SELECT concat('m', CAST(doc_id % 400 AS VARCHAR)) AS path, strlen(text) AS bytes, sha256(text) AS sha256, strlen(text) // 2 AS packed, source, doc_id FROM documents"


def members(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    content = F.encode("text", "UTF-8")
    return docs.select(F.concat(F.lit("m"), (F.col("doc_id") % 400).cast("string")).alias("path"), F.length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"),
                       F.floor(F.length(content) / 2).alias("packed"), "source", "doc_id")


@query(f"SELECT path, bytes, sha256 FROM ({MEMBERS})")
def io29_hash_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), (F.col("doc_id") % 400).cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return audit.inventory(docs)


@query(f"SELECT path, count(*) AS n FROM ({MEMBERS}) GROUP BY 1 HAVING count(*) > 1")
def so6_duplicates(spark, sf_dir):
    return audit.duplicates(members(spark, sf_dir), ["path"])


@query(f"""WITH m AS ({MEMBERS}) SELECT 'MEMBER_TOO_LARGE' AS code, path AS detail FROM m WHERE bytes > 10000 UNION ALL SELECT 'RATIO_TOO_HIGH', path FROM m WHERE bytes > 2 * greatest(packed, 1)
UNION ALL SELECT 'MEMBER_DUPLICATE', path FROM m GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'TOO_MANY_FILES', '' FROM (SELECT count(*) AS n FROM m) WHERE n > 256 UNION ALL SELECT 'TOTAL_TOO_LARGE', '' FROM (SELECT sum(bytes) AS b FROM m) WHERE b > 1000000""")
def au1_preflight(spark, sf_dir):
    return audit.preflight(members(spark, sf_dir), {"files": 256, "member": 10000, "total": 1000000, "ratio": 2})


SPLIT = f"WITH m AS ({MEMBERS}), want AS (SELECT path, bytes, sha256, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM m WHERE doc_id % 3 <> 0), have AS (SELECT path, bytes, sha256 FROM m WHERE doc_id % 3 <> 1)"


@query(SPLIT + """, w AS (SELECT path, min(bytes) AS wb, min(sha256) AS ws FROM want GROUP BY 1), h AS (SELECT path, min(bytes) AS b, min(sha256) AS s FROM have GROUP BY 1), j AS (SELECT coalesce(w.path, h.path) AS path, w.path IS NOT NULL AS d, h.path IS NOT NULL AS a, wb, ws, b, s FROM w FULL JOIN h ON w.path = h.path)
SELECT 'MEMBER_MISSING' AS code, path AS detail FROM j WHERE NOT a UNION ALL SELECT 'MEMBER_UNLISTED', path FROM j WHERE NOT d UNION ALL SELECT 'HASH_MISMATCH', path FROM j WHERE ws <> s UNION ALL SELECT 'SIZE_MISMATCH', path FROM j WHERE wb <> b
UNION ALL SELECT 'MANIFEST_DUPLICATE', path FROM want GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'MANIFEST_ORDER', path FROM (SELECT path, lag(path) OVER (ORDER BY position) AS before FROM want) WHERE path < before""")
def j9_manifest_audit(spark, sf_dir):
    m = members(spark, sf_dir)
    want = audit.numbered(m.where("doc_id % 3 <> 0"), [F.col("doc_id")], "position", first=0)
    return audit.manifest_audit(want, m.where("doc_id % 3 <> 1"))


@query("""WITH want AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 7 <> 0), have AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'MISSING' AS side, k FROM (SELECT k FROM want EXCEPT SELECT k FROM have) UNION ALL SELECT 'EXTRA', k FROM (SELECT k FROM have EXCEPT SELECT k FROM want)""")
def so3_key_difference(spark, sf_dir):
    want = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).where("k % 7 <> 0")
    return audit.key_difference(want, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).where("k % 5 <> 0"), ["k"])


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) + (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) = 0 AS same")
def so4_same_keys(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return audit.same_keys(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), items, ["k"])


@query("SELECT k, left_n AS left, right_n AS right, right_n - left_n AS delta FROM (SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS left_n, coalesce(y, 0) AS right_n FROM (SELECT o_orderpriority AS k, count(*) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS y FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.k = b.k)")
def j21_class_deltas(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "k")
    return audit.class_deltas(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), "k")


@query("""WITH i AS (SELECT l_orderkey AS k FROM lineitem WHERE l_orderkey % 7 <> 0), p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0), c AS (SELECT k, count(*) AS n FROM i GROUP BY 1)
SELECT 'ORPHAN' AS code, k, n FROM c WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT 'COUNT', p.k, coalesce(n, 0) FROM (SELECT DISTINCT k FROM p) p LEFT JOIN c ON c.k = p.k WHERE coalesce(n, 0) <> 4""")
def j7_orphans(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).where("k % 7 <> 0")
    return audit.orphans(children, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).where("k % 5 <> 0"), "k", 4)


@query("""WITH a AS (SELECT p_brand AS k, count(*)::DOUBLE AS n, max(p_size)::DOUBLE AS s FROM part GROUP BY 1), b AS (SELECT p_brand AS k, count(*)::DOUBLE AS n, max(p_size)::DOUBLE AS s FROM part WHERE p_partkey % 11 <> 0 AND p_brand <> 'Brand#11' GROUP BY 1), j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NULL OR b.k IS NULL AS gone, a.n AS an, b.n AS bn, a.s AS s1, b.s AS s2 FROM a FULL JOIN b ON a.k = b.k)
SELECT k, 'n' AS path, an AS left, bn AS right FROM j WHERE gone OR abs(an - bn) > 1e-12 UNION ALL SELECT k, 's', s1, s2 FROM j WHERE gone OR abs(s1 - s2) > 1e-12""")
def j4_table_comparison(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "k")
    stats = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("p_size").cast("double").alias("s"))
    return audit.compare_tables(stats(part), stats(part.where("p_partkey % 11 <> 0 and k <> 'Brand#11'")), ["k"], ["n", "s"])


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)")
def j8_referential_integrity(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().join(known, "l_suppkey", "left_anti")


@query("SELECT s_suppkey, CASE WHEN NOT s_acctbal > 0 THEN 'BALANCE' WHEN NOT s_nationkey < 20 THEN 'NATION' WHEN NOT s_suppkey % 4 <> 0 THEN 'KEY' ELSE 'ADMITTED' END AS status, CAST(s_acctbal <= 0 AS BIGINT) + CAST(s_nationkey >= 20 AS BIGINT) + CAST(s_suppkey % 4 = 0 AS BIGINT) AS failed, concat('scout-', substr(sha256(concat_ws('|', CAST(s_suppkey AS VARCHAR), s_name)), 1, 16)) AS receipt FROM supplier")
def pf6_ordered_gate(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    out = audit.first_failure(s, {"BALANCE": F.col("s_acctbal") > 0, "NATION": F.col("s_nationkey") < 20, "KEY": F.col("s_suppkey") % 4 != 0}, "ADMITTED")
    return result(out.select("s_suppkey", "status", "failed", audit.receipt_id("scout", F.col("s_suppkey"), F.col("s_name")).alias("receipt")))


@query("SELECT c_custkey, CAST(CAST('0x' || substr(sha256(c_name), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM customer")
def fn_hash_to_seed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", audit.seed_of(F.col("c_name")).cast("string").alias("seed"))


@query("WITH s AS (SELECT n_nationkey, k FROM nation, (SELECT unnest(range(0, 4)) AS k)), f AS (SELECT s_nationkey AS n_nationkey, s_suppkey % 4 AS k, count(*) AS n FROM supplier GROUP BY 1, 2) SELECT CAST(s.n_nationkey AS BIGINT) AS n_nationkey, CAST(s.k AS BIGINT) AS k, coalesce(CAST(n AS VARCHAR), 'UNRESOLVED') AS n FROM s LEFT JOIN f ON f.n_nationkey = s.n_nationkey AND f.k = s.k")
def j22_dense_spine(spark, sf_dir):
    spine = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    facts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("n_nationkey"), (F.col("s_suppkey") % 4).alias("k")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    return audit.from_spine(spine, facts, ["n_nationkey", "k"], {"n": F.lit("UNRESOLVED")})


@query("SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def so2_union_by_name(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return audit.union_all([n, s])


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal > 0 DESC, round(s_acctbal / 1000) DESC, s_name) AS rank FROM supplier")
def st6_candidate_ranking(spark, sf_dir):
    order = [F.desc(F.col("s_acctbal") > 0), F.desc(F.round(F.col("s_acctbal") / 1000)), F.col("s_name").asc()]
    return result(audit.ranked(table(spark, sf_dir, "supplier"), order).select("s_suppkey", "rank"))


@query("SELECT event_type AS classification, count(*) AS points, round(avg(value), 6) + 0.0 AS mean_value FROM events GROUP BY 1")
def ag1_result_statistics(spark, sf_dir):
    return result(summaries.result_statistics(table(spark, sf_dir, "events").withColumnRenamed("event_type", "classification"), "classification", "value"))


@query("SELECT winner, count(*) AS n FROM (SELECT nullif(l_linenumber % 4, 0) AS winner FROM lineitem) WHERE winner IS NOT NULL GROUP BY 1")
def ag2_winner_histogram(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.nullif((F.col("l_linenumber") % 4).cast("long"), F.lit(0)).alias("winner"))
    return summaries.winner_histogram(items)


SURFACE = "SELECT CASE o_custkey % 6 WHEN 0 THEN 'baseline' ELSE concat('c', CAST(o_custkey % 6 AS VARCHAR)) END AS condition, 6 + o_orderkey % 9 AS n, count(*) AS parents, avg(CAST(o_totalprice > 200000 AS DOUBLE)) AS ui, median(o_totalprice) / 100000 AS nss, avg(o_totalprice) > 245000 OR (6 + o_orderkey % 9) IN (8, 9, 10) AS sep FROM orders GROUP BY 1, 2, (6 + o_orderkey % 9) IN (8, 9, 10)"


def toy_surface(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_custkey") % 6 == 0, "baseline").otherwise(F.concat(F.lit("c"), (F.col("o_custkey") % 6).cast("string")))
    n = 6 + F.col("o_orderkey") % 9
    return o.groupBy(name.alias("condition"), n.alias("n")).agg(
        F.count(F.lit(1)).alias("parents"), F.avg((F.col("o_totalprice") > 200000).cast("double")).alias("ui"), (F.median("o_totalprice") / 100000).alias("nss"), F.avg("o_totalprice").alias("m")).withColumn(
        "sep", (F.col("m") > 245000) | F.col("n").isin(8, 9, 10)).drop("m")


@query(f"""WITH s AS ({SURFACE}), f AS (SELECT n, coalesce(bool_or(sep) FILTER (WHERE condition = 'baseline'), false) AND count(*) FILTER (WHERE sep AND condition <> 'baseline') >= 4 AS ok FROM s GROUP BY 1), t AS (SELECT min(n) FILTER (WHERE sep) AS t_e FROM s WHERE condition = 'baseline'),
i AS (SELECT n, ok, row_number() OVER (ORDER BY n) - row_number() OVER (PARTITION BY ok ORDER BY n) AS i FROM f), runs AS (SELECT min(n) AS a, max(n) AS z, count(*) AS size FROM i WHERE ok GROUP BY i), e AS (SELECT t_e, max(z) AS z FROM t LEFT JOIN runs ON t_e BETWEEN a AND z GROUP BY 1)
SELECT t_e, count(DISTINCT n) FILTER (WHERE n >= t_e AND n <= z) AS region_size, {r('coalesce(avg(CAST(sep AS DOUBLE)) FILTER (WHERE parents >= 10 AND n >= t_e AND n <= z), 0.0)', 's_e')}, {r('coalesce(avg(CAST(sep AS DOUBLE)) FILTER (WHERE parents >= 10), 0.0)', 'auc_sep')}, (SELECT coalesce(max(size), 0) FROM runs) AS longest_run, {r('''avg(CAST(sep AS DOUBLE)) FILTER (WHERE condition <> 'baseline' AND n = t_e)''', 'perturbation_survival')} FROM s, e GROUP BY t_e""")
def ag32_population_endpoints(spark, sf_dir):
    return result(endpoints.population_endpoints(toy_surface(spark, sf_dir)))


@query(f"WITH s AS ({SURFACE}) SELECT a.condition, a.n, round(a.ui - b.ui, 6) + 0.0 AS delta_ui, round(a.nss - b.nss, 6) + 0.0 AS delta_nss FROM s a JOIN s b ON a.n = b.n AND b.condition = 'baseline' WHERE a.condition <> 'baseline'")
def j2_surface_deltas(spark, sf_dir):
    return result(endpoints.surface_deltas(toy_surface(spark, sf_dir)))


@query("SELECT a.user_id, a.k, round(a.v - b.v, 6) + 0.0 AS delta FROM (SELECT user_id, hour(ts) AS k, avg(sqrt(value)) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2) a JOIN (SELECT user_id, hour(ts) AS k, avg(sqrt(value)) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.k = b.k")
def j11_paired_deltas(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    role = lambda kind: events.where(F.col("event_type") == kind).groupBy("user_id", F.hour("ts").alias("k")).agg(F.avg(F.sqrt("value")).alias("score"))
    return result(inference.paired_deltas(role("click"), role("view"), ["user_id", "k"]))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS path, regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1), '(^|/)\\.\\.?(/|$)') OR regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) = '' OR starts_with(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1), '/') AS unsafe FROM pages")
def pf10_unsafe_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)?", 1).alias("path"))
    return pages.withColumn("unsafe", audit.unsafe_path(F.col("path")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def io3_json_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"].alias("k"))


@query("SELECT item_id, TRY_CAST(CASE WHEN upper(trim(w)) NOT IN ('', 'NA', 'NAN') THEN w END AS DOUBLE) AS value FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN ' na ' WHEN 1 THEN '' WHEN 2 THEN '12.5' ELSE 'x' END AS w FROM benchmark)")
def io6_number_or_null(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, " na ").when(F.col("item_id") % 4 == 1, "").when(F.col("item_id") % 4 == 2, "12.5").otherwise("x").alias("w"))
    return rows.select("item_id", number_or_null("w").alias("value"))


@query("SELECT event_id, ts - INTERVAL 8 HOURS AS utc, strftime(ts, '%Y-%m-%dT%H') AS local_hour, year(ts) AS y, month(ts) AS m, CAST(floor(epoch(date_trunc('day', ts)) / 86400 / 7) AS BIGINT) AS week7, CAST(date_trunc('month', ts) AS DATE) AS month_start, isodow(ts) - 1 AS weekday FROM events")
def fn_time_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = e.select("event_id", (F.col("ts") - F.expr("INTERVAL 8 HOURS")).alias("utc"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("local_hour"), F.year("ts").alias("y"), F.month("ts").alias("m"),
                   F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / 7).alias("week7"), F.trunc("ts", "month").alias("month_start"), F.weekday("ts").alias("weekday"))
    return result(out)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'LOW' ELSE 'OK' END AS band, greatest(0.0, least(1.0, s_acctbal / 10000)) AS clamped, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS padded, coalesce(nullif(s_nationkey, 3), -1)::BIGINT AS nation FROM supplier")
def pf2_scalar_functions(spark, sf_dir):
    from gneiss.operators.dynamics import clamp

    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.when(F.col("s_acctbal") < 0, "LOW").otherwise("OK").alias("band"), clamp(F.col("s_acctbal") / 10000, 0.0, 1.0).alias("clamped"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("padded"),
                    F.coalesce(F.nullif("s_nationkey", F.lit(3)), F.lit(-1)).cast("long").alias("nation"))


@query("SELECT s.n_nationkey::BIGINT AS station, c.condition, CAST(k AS BIGINT) AS child, concat('L-', lpad(CAST(s.n_nationkey AS VARCHAR), 2, '0'), '-', c.condition, '-', lpad(CAST(k AS VARCHAR), 3, '0')) AS ladder_id FROM nation s, (SELECT unnest(['baseline', 'scale_095', 'scale_105']) AS condition) c, (SELECT unnest(range(0, 8)) AS k)")
def j18_ladder_registry(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("station"), F.explode(F.array(*(F.lit(c) for c in ("baseline", "scale_095", "scale_105")))).alias("condition"))
    every = base.withColumn("child", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    return every.withColumn("ladder_id", F.concat(F.lit("L-"), F.lpad(F.col("station").cast("string"), 2, "0"), F.lit("-"), "condition", F.lit("-"), F.lpad(F.col("child").cast("string"), 3, "0")))


@query("SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha256, text LIKE '%' || chr(13) || '%' AS changed FROM (SELECT doc_id, replace(text, ' ', chr(13) || chr(10)) AS text FROM documents WHERE text IS NOT NULL)")
def io31_normalized_lines(spark, sf_dir):
    """Documents whose spaces have become Windows line ends, normalized."""
    from gneiss.sources.archives import normalized_lines

    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.encode(F.replace("text", F.lit(" "), F.lit("\r\n")), "UTF-8").alias("content"))
    return normalized_lines(docs).select(F.col("path").alias("doc_id"), "sha256", "changed")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL)
SELECT doc_id, place AS line, 'ADDRESS' AS code FROM l WHERE regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+') UNION ALL SELECT doc_id, place, 'LICENSE' FROM l WHERE regexp_matches(line, '[Ll]icen[cs]ed? ')""")
def io31_content_scan(spark, sf_dir):
    from gneiss.sources.archives import content_scan

    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    found = content_scan(docs, {"ADDRESS": "[a-z0-9.]+@[a-z0-9.]+", "LICENSE": "[Ll]icen[cs]ed? "})
    return found.select(F.col("path").alias("doc_id"), F.col("line").cast("long").alias("line"), "code")


@query("SELECT 'x/Data_' || n_name || '_' || n_nationkey || '.csv' AS member, n_name AS station FROM nation")
def io8_station_of_name(spark, sf_dir):
    from gneiss.sources.archives import station_of

    nations = table(spark, sf_dir, "nation")
    names = [x.n_name for x in nations.select("n_name").collect()]  # the registry of stations: 25 names
    member = F.concat(F.lit("x/Data_"), F.col("n_name"), F.lit("_"), F.col("n_nationkey").cast("string"), F.lit(".csv"))
    return nations.select(member.alias("member")).withColumn("station", station_of(F.col("member"), names))
