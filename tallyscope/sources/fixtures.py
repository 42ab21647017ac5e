"""Returns tables derived from the driver's TPC-H-style tables.

A customer is a precinct, a nation a jurisdiction and a line item a batch of
``l_quantity`` ballots. The Spark plan aggregates line items per order first
(partial aggregation before the shuffle, so a hot order or customer collapses
map-side), joins orders 1:1, aggregates per customer (again map-side combined)
and only then joins the customer and nation dimensions, which are 1:1 with the
result. No join in this plan multiplies a hot key.

The SQL text below is the same fixture for DuckDB (the oracle); Spark never
parses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import join_dimension


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sum_if(cond: Column, q: Column, name: str) -> Column:
    return F.sum(F.when(cond, q).otherwise(F.lit(0.0))).alias(name)


_COUNT_COLUMNS = (
    "Registered_Voters",
    "Ballots_Cast",
    "Valid_Contest_Votes",
    "Undervotes",
    "Overvotes",
    "Votes_Candidate_A",
    "Votes_Candidate_B",
    "Votes_Candidate_C",
    "Write_In_Votes",
    "Votes_Down_Ballot_A",
    "Votes_Down_Ballot_B",
)


def _line_sums(lineitem: DataFrame) -> list[Column]:
    q = F.col("l_quantity")
    d = F.round(F.col("l_discount") * 100).cast("int")
    t = F.round(F.col("l_tax") * 100).cast("int")
    rf, ls, ln = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    ballot = t >= 3
    valid = ballot & (d > 0) & ~((d == 1) & (ln == 7))
    return [
        F.sum(q).alias("Registered_Voters"),
        _sum_if(ballot, q, "Ballots_Cast"),
        _sum_if(valid, q, "Valid_Contest_Votes"),
        _sum_if(ballot & (d == 0), q, "Undervotes"),
        _sum_if(ballot & (d == 1) & (ln == 7), q, "Overvotes"),
        _sum_if(valid & (rf == "A"), q, "Votes_Candidate_A"),
        _sum_if(valid & (rf == "N"), q, "Votes_Candidate_B"),
        _sum_if(valid & (rf == "R") & (ln != 7), q, "Votes_Candidate_C"),
        _sum_if(valid & (rf == "R") & (ln == 7), q, "Write_In_Votes"),
        _sum_if(valid & (((rf == "A") & (d != 10)) | ((rf == "N") & (d == 10) & (ls == "F"))), q, "Votes_Down_Ballot_A"),
        _sum_if(valid & (((rf == "N") & (d != 10)) | ((rf == "A") & (d == 10) & (ls == "F"))), q, "Votes_Down_Ballot_B"),
    ]


def returns(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """One row per precinct (customer), or per precinct x vote type (order priority)."""
    lineitem = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"
    )
    per_order = lineitem.groupBy("l_orderkey").agg(*_line_sums(lineitem))
    order_cols = ["o_orderkey", "o_custkey"] + (["o_orderpriority"] if by_type else [])
    orders = read_table(spark, sf_dir, "orders").select(*order_cols)
    keyed = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
    group = [F.col("o_custkey").alias("k")] + ([F.col("o_orderpriority").alias("Vote_Type")] if by_type else [])
    per_unit = keyed.groupBy(*group).agg(*[F.sum(c).cast("bigint").alias(c) for c in _COUNT_COLUMNS])

    customer = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("Precinct"), F.col("c_nationkey").alias("nk")
    )
    nation = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nk"), F.col("n_name").alias("Jurisdiction")
    )
    units = per_unit.join(customer, "k")
    units = join_dimension(units, nation, "nk")
    k, nk = F.col("k"), F.col("nk")
    lat = F.lit(30) + ((nk * 7) % 25) * 2 / 5 + ((k * 7919) % 100003) / 250000
    lon = F.lit(-120) + ((nk * 11) % 25) * 6 / 5 + ((k * 15485863) % 100003) / 100003
    ident = ["k", "Jurisdiction", "Precinct"] + (["Vote_Type"] if by_type else [])
    return units.select(
        *ident,
        *_COUNT_COLUMNS,
        lat.alias("Latitude"),
        lon.alias("Longitude"),
        F.round(100 * F.col("Ballots_Cast") / F.col("Registered_Voters"), 2).alias("Reported_Turnout_Percent"),
    )


def returns_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-STRING returns with one defect per ``k % 101`` class (see FIXTURES.md)."""
    r = returns(spark, sf_dir)
    m = F.col("k") % 101
    s = lambda c: F.col(c).cast("string")
    raw = r.select(
        s("k").alias("k"),
        F.when(m == 15, F.concat(F.lit("  "), F.col("Jurisdiction"), F.lit(" "))).otherwise(F.col("Jurisdiction")).alias("Jurisdiction"),
        F.when(m == 6, F.lit("  ")).otherwise(F.col("Precinct")).alias("Precinct"),
        s("Registered_Voters").alias("Registered_Voters"),
        F.when(m == 5, F.col("Registered_Voters") + 1).otherwise(F.col("Ballots_Cast")).cast("string").alias("Ballots_Cast"),
        F.when(m == 4, F.col("Ballots_Cast") + 1).otherwise(F.col("Valid_Contest_Votes")).cast("string").alias("Valid_Contest_Votes"),
        F.when(m == 1, F.lit("-1"))
        .when(m == 2, F.lit("1.5"))
        .when(m == 3, (F.col("Valid_Contest_Votes") + 1).cast("string"))
        .when(m == 7, F.lit("abc"))
        .otherwise(s("Votes_Candidate_A"))
        .alias("Votes_Candidate_A"),
        F.when(m == 8, F.lit(None).cast("string")).otherwise(s("Votes_Candidate_B")).alias("Votes_Candidate_B"),
        s("Votes_Candidate_C").alias("Votes_Candidate_C"),
        F.when(m == 16, F.lit(None).cast("string")).otherwise(s("Write_In_Votes")).alias("Write_In_Votes"),
        F.when(m == 9, F.lit("91")).otherwise(s("Latitude")).alias("Latitude"),
        F.when(m == 10, F.lit(None).cast("string")).otherwise(s("Longitude")).alias("Longitude"),
        F.when(m == 11, F.lit("not reported"))
        .when(m == 12, F.lit("101"))
        .when(m == 13, F.lit("1"))
        .otherwise(s("Reported_Turnout_Percent"))
        .alias("Reported_Turnout_Percent"),
    )
    return raw.unionByName(raw.filter(F.col("k").cast("bigint") % 101 == 14))


# Fixed value: precinct squares are laid out on a grid this many cells wide.
POLYGON_GRID_WIDTH = 40


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit square per precinct on a fixed-width grid, as a closed vertex ring."""
    r = returns(spark, sf_dir).select("k", "Jurisdiction", "Precinct")
    x = (F.col("k") % POLYGON_GRID_WIDTH).cast("double")
    y = F.floor(F.col("k") / POLYGON_GRID_WIDTH).cast("double")
    pt = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 1), pt(0, 0))
    pid = F.concat_ws("::", F.col("Jurisdiction"), F.col("Precinct"))
    return r.select(pid.alias("Precinct_ID"), ring.alias("Geometry"))


# ------------------------------------------------------------------ oracle SQL

RETURNS_SQL = """
WITH b AS (
  SELECT c.c_custkey AS k, n.n_nationkey AS nk, n.n_name AS Jurisdiction, c.c_name AS Precinct{vt_b},
         l.l_quantity AS q, CAST(round(l.l_discount * 100) AS INT) AS d,
         CAST(round(l.l_tax * 100) AS INT) AS t,
         l.l_returnflag AS rf, l.l_linestatus AS ls, l.l_linenumber AS ln
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
f AS (SELECT *, t >= 3 AS ballot, (t >= 3 AND d > 0 AND NOT (d = 1 AND ln = 7)) AS valid FROM b),
g AS (
SELECT k, Jurisdiction, Precinct{vt_s},
  CAST(sum(q) AS BIGINT) AS Registered_Voters,
  CAST(sum(CASE WHEN ballot THEN q ELSE 0 END) AS BIGINT) AS Ballots_Cast,
  CAST(sum(CASE WHEN valid THEN q ELSE 0 END) AS BIGINT) AS Valid_Contest_Votes,
  CAST(sum(CASE WHEN ballot AND d = 0 THEN q ELSE 0 END) AS BIGINT) AS Undervotes,
  CAST(sum(CASE WHEN ballot AND d = 1 AND ln = 7 THEN q ELSE 0 END) AS BIGINT) AS Overvotes,
  CAST(sum(CASE WHEN valid AND rf = 'A' THEN q ELSE 0 END) AS BIGINT) AS Votes_Candidate_A,
  CAST(sum(CASE WHEN valid AND rf = 'N' THEN q ELSE 0 END) AS BIGINT) AS Votes_Candidate_B,
  CAST(sum(CASE WHEN valid AND rf = 'R' AND ln <> 7 THEN q ELSE 0 END) AS BIGINT) AS Votes_Candidate_C,
  CAST(sum(CASE WHEN valid AND rf = 'R' AND ln = 7 THEN q ELSE 0 END) AS BIGINT) AS Write_In_Votes,
  CAST(sum(CASE WHEN valid AND ((rf = 'A' AND d <> 10) OR (rf = 'N' AND d = 10 AND ls = 'F')) THEN q ELSE 0 END) AS BIGINT) AS Votes_Down_Ballot_A,
  CAST(sum(CASE WHEN valid AND ((rf = 'N' AND d <> 10) OR (rf = 'A' AND d = 10 AND ls = 'F')) THEN q ELSE 0 END) AS BIGINT) AS Votes_Down_Ballot_B,
  30 + ((min(nk) * 7) % 25) * 2 / 5 + ((k * 7919) % 100003) / 250000 AS Latitude,
  -120 + ((min(nk) * 11) % 25) * 6 / 5 + ((k * 15485863) % 100003) / 100003 AS Longitude
FROM f GROUP BY k, Jurisdiction, Precinct{vt_s})
SELECT *, round(100 * Ballots_Cast / Registered_Voters, 2) AS Reported_Turnout_Percent FROM g
"""


def returns_sql(by_type: bool = False) -> str:
    if by_type:
        return RETURNS_SQL.format(vt_b=", o.o_orderpriority AS Vote_Type", vt_s=", Vote_Type")
    return RETURNS_SQL.format(vt_b="", vt_s="")


RETURNS_RAW_SQL = """
WITH m AS (
SELECT CAST(k AS VARCHAR) AS k,
  CASE WHEN k % 101 = 15 THEN concat('  ', Jurisdiction, ' ') ELSE Jurisdiction END AS Jurisdiction,
  CASE WHEN k % 101 = 6 THEN '  ' ELSE Precinct END AS Precinct,
  CAST(Registered_Voters AS VARCHAR) AS Registered_Voters,
  CAST(CASE WHEN k % 101 = 5 THEN Registered_Voters + 1 ELSE Ballots_Cast END AS VARCHAR) AS Ballots_Cast,
  CAST(CASE WHEN k % 101 = 4 THEN Ballots_Cast + 1 ELSE Valid_Contest_Votes END AS VARCHAR) AS Valid_Contest_Votes,
  CASE k % 101 WHEN 1 THEN '-1' WHEN 2 THEN '1.5' WHEN 3 THEN CAST(Valid_Contest_Votes + 1 AS VARCHAR)
       WHEN 7 THEN 'abc' ELSE CAST(Votes_Candidate_A AS VARCHAR) END AS Votes_Candidate_A,
  CASE WHEN k % 101 = 8 THEN NULL ELSE CAST(Votes_Candidate_B AS VARCHAR) END AS Votes_Candidate_B,
  CAST(Votes_Candidate_C AS VARCHAR) AS Votes_Candidate_C,
  CASE WHEN k % 101 = 16 THEN NULL ELSE CAST(Write_In_Votes AS VARCHAR) END AS Write_In_Votes,
  CASE WHEN k % 101 = 9 THEN '91' ELSE CAST(Latitude AS VARCHAR) END AS Latitude,
  CASE WHEN k % 101 = 10 THEN NULL ELSE CAST(Longitude AS VARCHAR) END AS Longitude,
  CASE k % 101 WHEN 11 THEN 'not reported' WHEN 12 THEN '101' WHEN 13 THEN '1'
       ELSE CAST(Reported_Turnout_Percent AS VARCHAR) END AS Reported_Turnout_Percent
FROM returns)
SELECT * FROM m UNION ALL SELECT * FROM m WHERE CAST(k AS BIGINT) % 101 = 14
"""


def with_views(body: str, raw: bool = False, by_type: bool = False) -> str:
    """Wrap an oracle query so it can read ``returns`` (and ``returns_raw``)."""
    ctes = [f"returns AS ({returns_sql(by_type)})"]
    if raw:
        ctes.append(f"returns_raw AS ({RETURNS_RAW_SQL})")
    text = body.strip()
    recursive = text[:15].upper() == "WITH RECURSIVE "
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes)
    if recursive:
        return head + ",\n" + text[15:]
    if text[:5].upper() == "WITH ":
        return head + ",\n" + text[5:]
    return head + "\n" + text
