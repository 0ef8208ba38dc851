"""Lookups, panel joins, coverage, and group features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.catalog.base import Query, day, i, r, shape, table
from pitpanel.functions import parsing
from pitpanel.operators import features as feat
from pitpanel.operators import guards
from pitpanel.operators import lookup as lk
from pitpanel.session import cut_lineage


def part_key(column: str):
    return F.concat(F.lit("P"), F.lpad(F.col(column).cast("string"), 7, "0"))


def part_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """All parts form the lookup: fine key P + number, zone by runs of 1500 parts."""
    return table(spark, sf, "part").select(
        part_key("p_partkey").alias("postcode"),
        parsing.outward_key(part_key("p_partkey")).alias("outcode"),
        F.concat(F.lit("Z"), F.floor(F.col("p_partkey") / 1500).cast("string")).alias("ldz"),
        (F.col("p_size") > 5).alias("is_nts"),
    )


LOOKUP_SQL = """
lk AS (SELECT printf('P%07d', p_partkey) AS fine, printf('P%04d', p_partkey // 1000) AS coarse,
              'Z' || CAST(p_partkey // 1500 AS VARCHAR) AS zone, p_size > 5 AS flag
       FROM part),
ua AS (SELECT coarse, min(zone) AS zone, arg_min(flag, fine) AS flag FROM lk GROUP BY coarse
       HAVING count(DISTINCT zone) = 1)
"""


def assigned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a carelessly written part key; some lines have a key unknown in part or in whole."""
    lines = table(spark, sf, "lineitem").withColumn("l_unknown", F.col("l_partkey") + 5_000_000)
    known, kind = part_key("l_partkey"), F.col("l_linenumber") % 5
    key = F.when(kind == 0, part_key("l_unknown")).when(kind == 1, F.concat(F.substring(known, 1, 5), F.lit("ZZZ"))).otherwise(known)
    messy = F.concat(F.lit(" "), F.lower(F.substring(key, 1, 5)), F.lit("  "), F.substring(key, 6, 3))
    return lk.two_tier_lookup(lines.select("l_quantity", messy.alias("raw")), key="raw", lookup=part_lookup(spark, sf))


ASSIGNED_SQL = f"""
{LOOKUP_SQL},
asg AS (SELECT l_quantity, coalesce(lk.zone, ua.zone) AS zone,
               CASE WHEN lk.zone IS NOT NULL THEN lk.flag ELSE ua.flag END AS flag,
               CASE WHEN lk.zone IS NOT NULL THEN 'full' WHEN ua.zone IS NOT NULL THEN 'outcode' ELSE 'none' END AS level
        FROM (SELECT l_quantity, CASE WHEN l_linenumber % 5 = 0 THEN l_partkey + 5000000 ELSE l_partkey END AS k, l_linenumber FROM lineitem)
        LEFT JOIN lk ON printf('P%07d', k) = lk.fine AND l_linenumber % 5 <> 1
        LEFT JOIN ua ON printf('P%04d', k // 1000) = ua.coarse)
"""


def two_tier_lookup(spark: SparkSession, sf: str) -> DataFrame:
    out = assigned_lines(spark, sf).groupBy("ldz", "match_level", "is_nts").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")
    )
    return shape(out, ldz="text", match_level="text", is_nts="int", n="int", qty="double:2")


TWO_TIER_SQL = f"""
WITH {ASSIGNED_SQL}
SELECT zone AS ldz, level AS match_level, {i('flag')} AS is_nts, {i('count(*)')} AS n, {r('sum(l_quantity)', 2)} AS qty
FROM asg GROUP BY zone, level, flag
"""


def unambiguous_keys(spark: SparkSession, sf: str) -> DataFrame:
    out = lk.unambiguous_keys(part_lookup(spark, sf), fine="postcode", coarse="outcode", target="ldz", flag="is_nts")
    return shape(out, outcode="text", ldz="text", is_nts="int")


UNAMBIGUOUS_SQL = f"WITH {LOOKUP_SQL} SELECT coarse AS outcode, zone AS ldz, {i('flag')} AS is_nts FROM ua"


def match_level_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shape(lk.match_shares(assigned_lines(spark, sf)), match_level="text", n="int", share="double:6")


MATCH_SQL = f"""
WITH {ASSIGNED_SQL}
SELECT level AS match_level, {i('count(*)')} AS n, {r('count(*) / sum(count(*)) OVER ()', 6)} AS share FROM asg GROUP BY level
"""


def join_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that find their customer; every tenth order key names an unknown one."""
    unknown = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey"))
    orders = table(spark, sf, "orders").select(unknown.alias("c_custkey"), "o_orderkey")
    out = guards.join_coverage(orders, orders.join(table(spark, sf, "customer").select("c_custkey"), "c_custkey"))
    return shape(out, n_left="int", n_matched="int", ratio="double:6")


COVERAGE_SQL = f"""
SELECT {i('count(*)')} AS n_left, {i('count(c_custkey)')} AS n_matched, {r('count(c_custkey) / count(*)', 6)} AS ratio
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 10 <> 0
"""


def panel_join_left_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Five measures on (nation, month) joined left, then the all-nation value on every row."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf, "orders").join(customer, "o_custkey").withColumn("month", F.trunc("o_orderdate", "month"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    lines = table(spark, sf, "lineitem").join(supplier, "l_suppkey").withColumn("month", F.trunc("l_shipdate", "month"))
    keys = ["nation", "month"]
    # Two scans feed all five sides: conditional sums, whose few cells are stored.
    price = F.col("o_totalprice")
    cells = cut_lineage(orders.groupBy(*keys).agg(
        F.sum(price).alias("total"), F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("settled"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", price)).alias("urgent_max")))
    line_cells = cut_lineage(lines.groupBy(*keys).agg(
        F.sum("l_quantity").alias("shipped"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned")))
    base = panel = cells.select(*keys, "total")
    settled, urgent = (cells.select(*keys, c).dropna() for c in ("settled", "urgent_max"))
    shipped, returned = (line_cells.select(*keys, c).dropna() for c in ("shipped", "returned"))
    for side in (settled, urgent, shipped, returned):
        panel = panel.join(side, keys, "left")
    overall = base.groupBy("month").agg(F.sum("total").alias("overall"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    out = panel.join(overall, "month", "left").join(names, "nation", "left")
    return shape(out, name="text", month="date", total="double:2", settled="double:2", urgent_max="double:2",
                 shipped="double:2", returned="double:2", overall="double:2")


CHAIN_SQL = f"""
WITH o AS (SELECT c_nationkey AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, orders.*
           FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT s_nationkey AS nation, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, lineitem.*
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
base AS (SELECT nation, month, sum(o_totalprice) AS total FROM o GROUP BY 1, 2),
a AS (SELECT nation, month, sum(o_totalprice) AS settled FROM o WHERE o_orderstatus = 'F' GROUP BY 1, 2),
b AS (SELECT nation, month, max(o_totalprice) AS urgent_max FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2),
c AS (SELECT nation, month, sum(l_quantity) AS shipped FROM l GROUP BY 1, 2),
d AS (SELECT nation, month, sum(l_quantity) AS returned FROM l WHERE l_returnflag = 'R' GROUP BY 1, 2),
g AS (SELECT month, sum(total) AS overall FROM base GROUP BY 1)
SELECT n_name AS name, {day('month')} AS month, {r('total', 2)} AS total, {r('settled', 2)} AS settled,
       {r('urgent_max', 2)} AS urgent_max, {r('shipped', 2)} AS shipped, {r('returned', 2)} AS returned,
       {r('overall', 2)} AS overall
FROM base LEFT JOIN a USING (nation, month) LEFT JOIN b USING (nation, month) LEFT JOIN c USING (nation, month)
          LEFT JOIN d USING (nation, month) LEFT JOIN g USING (month) LEFT JOIN nation ON nation = n_nationkey
"""


def text_class_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword classes, first year and phrase flags over whole documents, shares per language."""
    classes = (("ation", "first"), ("lich|ment", "second"), ("tion|que", "third"))
    prepared = {
        "_kind": parsing.keyword_class("text", classes),
        "_flag": parsing.phrase_flag("text", "license|licence", "the|der"),
        "_year": parsing.first_year("text"),
    }
    kind, band = F.col("_kind"), parsing.year_band(F.col("_year"))
    measures = {
        "mean_chars": F.avg(parsing.within("n_chars", 100, 50000)),
        "share_first": feat.share(kind == "first"),
        "share_second": feat.share(kind == "second"),
        "share_third": feat.share(kind == "third"),
        "share_flag": feat.share(F.col("_flag")),
        "share_pre_1930": feat.share(band == "pre_1930"),
        "share_post_1996": feat.share(band == "post_1996"),
        "mean_year": F.avg("_year"),
    }
    out = feat.group_features(table(spark, sf, "documents"), by="lang", measures=measures, count="n", min_count=50,
                              covered="covered", prepared=prepared)
    return shape(out, lang="text", n="int", covered="int", **{name: "double:6" for name in measures})


_YEAR = r"TRY_CAST(nullif(regexp_extract(text, '(\d{4})', 1), '') AS INTEGER)"

TEXT_SQL = f"""
WITH t AS (SELECT lang, n_chars, {_YEAR} AS yr, lower(text) AS lt FROM documents),
k AS (SELECT *, CASE WHEN regexp_matches(lt, 'ation') THEN 'first' WHEN regexp_matches(lt, 'lich|ment') THEN 'second'
                     WHEN regexp_matches(lt, 'tion|que') THEN 'third' END AS kind,
             CASE WHEN regexp_matches(lt, 'license|licence') THEN 0.0 WHEN regexp_matches(lt, 'the|der') THEN 1.0 END AS flag
      FROM t)
SELECT lang, {i('count(*)')} AS n, {i('count(*) >= 50')} AS covered,
       {r('avg(CASE WHEN n_chars > 100 AND n_chars < 50000 THEN n_chars END)', 6)} AS mean_chars,
       {", ".join(f"{r(f'''avg(CAST(kind = '{k}' AS DOUBLE))''', 6)} AS share_{k}" for k in ("first", "second", "third"))},
       {r('avg(flag)', 6)} AS share_flag,
       {r('avg(CASE WHEN yr IS NOT NULL THEN CAST(yr <= 1929 AS DOUBLE) END)', 6)} AS share_pre_1930,
       {r('avg(CASE WHEN yr IS NOT NULL THEN CAST(yr > 1995 AS DOUBLE) END)', 6)} AS share_post_1996,
       {r('avg(yr)', 6)} AS mean_year
FROM k GROUP BY lang
"""


def part_feature_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Flags, rating lists, ranges and codes from part attributes, per brand."""
    part = table(spark, sf, "part").withColumn(
        "label", F.concat(F.lit("Price, LDZ ("), F.upper(F.substring("p_type", 1, 2)), F.lit(")"))
    )
    measures = {
        "share_small": feat.share(parsing.rated_poor("p_type", ("small", "economy"))),
        "mean_size": F.avg(parsing.within("p_size", 10, 40)),
        "share_yes": feat.share(parsing.is_yes(F.substring("p_name", -1, 1))),
        "share_coded": feat.share(parsing.code_in_label("label", ["SM", "ME", "LA"]).isNotNull()),
        "mean_price": F.avg(parsing.number(F.col("p_retailprice").cast("string"))),
    }
    out = feat.group_features(part, by="p_brand", measures=measures, count="n", min_count=1, covered="covered")
    return shape(out, p_brand="text", n="int", **{name: "double:6" for name in measures})


PART_SQL = f"""
SELECT p_brand, {i('count(*)')} AS n, {r("avg(CAST(lower(p_type) IN ('small', 'economy') AS DOUBLE))", 6)} AS share_small,
       {r('avg(CASE WHEN p_size > 10 AND p_size < 40 THEN p_size END)', 6)} AS mean_size,
       {r("avg(CAST(upper(right(p_name, 1)) = 'Y' AS DOUBLE))", 6)} AS share_yes,
       {r("avg(CAST(upper(substr(p_type, 1, 2)) IN ('SM', 'ME', 'LA') AS DOUBLE))", 6)} AS share_coded,
       {r('avg(p_retailprice)', 6)} AS mean_price
FROM part GROUP BY p_brand
"""


def zscore_covered_only(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier features standardised over suppliers with at least 590 lines."""
    measures = {
        "mean_qty": F.avg("l_quantity"),
        "share_returned": feat.share(F.col("l_returnflag") == "R"),
        "mean_discount": F.avg("l_discount"),
    }
    raw = feat.group_features(table(spark, sf, "lineitem"), by="l_suppkey", measures=measures, count="n", min_count=590,
                              covered="covered")
    out = feat.standardise(raw, list(measures), covered="covered")
    return shape(out, l_suppkey="int", n="int", covered="int", **{f"{m}_z": "double:6" for m in measures})


ZSCORE_SQL = f"""
WITH f AS (SELECT l_suppkey, count(*) AS n, count(*) >= 590 AS covered, avg(l_quantity) AS mean_qty,
                  avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS share_returned, avg(l_discount) AS mean_discount
           FROM lineitem GROUP BY 1)
SELECT {i('l_suppkey')} AS l_suppkey, {i('n')} AS n, {i('covered')} AS covered,
       {", ".join(f"{r(f'CASE WHEN covered THEN ({m} - avg({m}) FILTER (covered) OVER ()) / stddev_pop({m}) FILTER (covered) OVER () END', 6)} AS {m}_z" for m in ("mean_qty", "share_returned", "mean_discount"))}
FROM f
"""

QUERIES = [
    Query("two_tier_lookup", two_tier_lookup, TWO_TIER_SQL, "C9 H1 H2"),
    Query("unambiguous_keys", unambiguous_keys, UNAMBIGUOUS_SQL, "C10"),
    Query("match_level_shares", match_level_shares, MATCH_SQL, "D22"),
    Query("join_coverage", join_coverage, COVERAGE_SQL, "C5 D23"),
    Query("panel_join_left_chain", panel_join_left_chain, CHAIN_SQL, "C1 C2 C3 C4"),
    Query("text_class_shares", text_class_shares, TEXT_SQL, "H3 H4 H5 H6 B4 D4"),
    Query("part_feature_shares", part_feature_shares, PART_SQL, "H7 H8 B3 B4 D4"),
    Query("zscore_covered_only", zscore_covered_only, ZSCORE_SQL, "D5"),
]
