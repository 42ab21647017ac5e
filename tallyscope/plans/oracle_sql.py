"""DuckDB oracle SQL for the registered queries (independent re-statement in SQL).

Only the driver's correctness check runs these strings; the engine never does.
"""

from __future__ import annotations

from ..sources.fixtures import with_views

NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
Z975 = 1.959963984540054  # standard normal 0.975 quantile (confidence 0.95)


def t975(df: str) -> str:
    """Student-t 0.975 quantile for df degrees of freedom (Cornish-Fisher, error < 1e-11 for df > 100)."""
    z = Z975
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    v = f"CAST({df} AS DOUBLE)"
    return f"({z!r} + {g1!r}/{v} + {g2!r}/({v}*{v}) + {g3!r}/({v}*{v}*{v}) + {g4!r}/({v}*{v}*{v}*{v}))"


def _na(c: str) -> str:
    return f"CASE WHEN {c} IN {NA} THEN NULL ELSE {c} END"


def _num(c: str) -> str:
    x = _na(c)
    return f"CASE WHEN regexp_matches({x}, {NUM}) THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def _trim(c: str) -> str:
    return f"regexp_replace({_na(c)}, '^\\s+|\\s+$', '', 'g')"


COUNTS = ["Votes_Candidate_A", "Votes_Candidate_B", "Votes_Candidate_C", "Registered_Voters",
          "Ballots_Cast", "Valid_Contest_Votes", "Write_In_Votes"]
CANDS = ["Votes_Candidate_A", "Votes_Candidate_B", "Votes_Candidate_C"]
SHARES = {"Votes_Candidate_A": "candidate_a", "Votes_Candidate_B": "candidate_b", "Votes_Candidate_C": "candidate_c"}

# Parsed view of returns_raw (P6-P13), keeping raw text for the rules.
PARSED = (
    "p0 AS (SELECT *, "
    + ", ".join(f"{_num(c)} AS n_{c}" for c in COUNTS)
    + f", {_num('Latitude')} AS n_lat, {_num('Longitude')} AS n_lon, {_num('Reported_Turnout_Percent')} AS n_rep, "
    + f"{_trim('Jurisdiction')} AS t_j, {_trim('Precinct')} AS t_p FROM returns_raw),\n"
    + "p AS (SELECT *, coalesce(t_j, '') || '::' || coalesce(t_p, '') AS Precinct_ID, "
    + "CASE WHEN n_Registered_Voters > 0 THEN n_Ballots_Cast / n_Registered_Voters * 100 END AS calc, "
    + "count(*) OVER (PARTITION BY coalesce(t_j, '') || '::' || coalesce(t_p, '')) AS dupn FROM p0)"
)


def _rules() -> list[tuple[str, str, str | None, str]]:
    """(code, severity, column, predicate over p) - one per issue the engine can emit."""
    r: list[tuple[str, str, str | None, str]] = []
    for c, t in (("Jurisdiction", "t_j"), ("Precinct", "t_p")):
        r.append(("missing_identifier", "error", c, f"({t} IS NULL OR {t} = '')"))
    for c in COUNTS:
        n = f"n_{c}"
        r.append(("nonnumeric_count", "error", c, f"({_na(c)} IS NOT NULL AND {n} IS NULL)"))
        r.append(("nonintegral_count", "error", c, f"({n} IS NOT NULL AND abs({n} - round({n})) > 1e-8 + 1e-5 * abs(round({n})))"))
        r.append(("negative_count", "error", c, f"({n} < 0)"))
    for c, n, lo, hi in (("Latitude", "n_lat", -90, 90), ("Longitude", "n_lon", -180, 180)):
        r.append(("invalid_or_missing_coordinate", "warning", c, f"({n} IS NULL OR NOT ({n} BETWEEN {lo} AND {hi}))"))
    rep = "Reported_Turnout_Percent"
    r.append(("nonnumeric_reported_turnout", "error", rep, f"({_na(rep)} IS NOT NULL AND n_rep IS NULL)"))
    r.append(("impossible_reported_turnout", "error", rep, "(n_rep IS NOT NULL AND NOT (n_rep BETWEEN 0 AND 100))"))
    for c in ("Valid_Contest_Votes", *CANDS, "Ballots_Cast"):
        r.append(("missing_critical_count", "error", c, f"(n_{c} IS NULL)"))
    any_c = " OR ".join(f"n_{c} IS NOT NULL" for c in CANDS)
    sum_c = " + ".join(f"coalesce(n_{c}, 0)" for c in CANDS)
    r.append(("candidate_votes_exceed_contest", "error", None,
              f"(({any_c}) AND ({sum_c}) + coalesce(n_Write_In_Votes, 0) > n_Valid_Contest_Votes)"))
    r.append(("contest_votes_exceed_ballots", "error", None, "(n_Valid_Contest_Votes > n_Ballots_Cast)"))
    r.append(("ballots_exceed_registration", "error", None, "(n_Ballots_Cast > n_Registered_Voters)"))
    r.append(("turnout_mismatch", "warning", None, "(abs(n_rep - calc) > 1.0)"))
    r.append(("duplicate_precinct_id", "error", None, "(dupn > 1)"))
    return r


RULES = _rules()


def _pred(p: str) -> str:
    return f"coalesce({p}, false)"


def _any_error() -> str:
    return " OR ".join(_pred(p) for _c, s, _col, p in RULES if s == "error")


def _canonical_select(prefix: str = "") -> str:
    cols = [
        "Precinct_ID", "t_j AS Jurisdiction", "t_p AS Precinct",
        *[f"round(n_{c}, 6) AS {c}" for c in ("Registered_Voters", "Ballots_Cast", "Valid_Contest_Votes", "Write_In_Votes", *CANDS)],
        "round(CASE WHEN n_lat BETWEEN -90 AND 90 THEN n_lat END, 6) AS Latitude",
        "round(CASE WHEN n_lon BETWEEN -180 AND 180 THEN n_lon END, 6) AS Longitude",
        "round(n_rep, 6) AS Reported_Turnout_Percent",
        *[f"round(CASE WHEN n_Valid_Contest_Votes > 0 THEN n_{c} / n_Valid_Contest_Votes END, 6) AS Candidate_Share__{k}" for c, k in SHARES.items()],
        "round(calc, 6) AS Calculated_Turnout_Percent",
        "round(abs(n_rep - calc), 6) AS Turnout_Discrepancy_Percentage_Points",
    ]
    return ", ".join(cols)


def returns_canonical() -> str:
    return with_views(f"WITH {PARSED}\nSELECT {_canonical_select()} FROM p", raw=True)


def returns_issues() -> str:
    parts = [
        f"SELECT Precinct_ID, '{code}' AS code, '{sev}' AS severity, {('NULL' if col is None else repr(col))} AS \"column\" FROM p WHERE {_pred(pred)}"
        for code, sev, col, pred in RULES
    ]
    body = f"WITH {PARSED}\nSELECT Precinct_ID, code, severity, CAST(\"column\" AS VARCHAR) AS \"column\" FROM (\n" + "\nUNION ALL\n".join(parts) + ")"
    return with_views(body, raw=True)


def returns_issue_counts() -> str:
    parts = [f"SELECT '{code}' AS code, '{sev}' AS severity FROM p WHERE {_pred(pred)}" for code, sev, _c, pred in RULES]
    body = f"WITH {PARSED}\nSELECT code, severity, count(*) AS n FROM (\n" + "\nUNION ALL\n".join(parts) + ") GROUP BY code, severity"
    return with_views(body, raw=True)


def returns_accepted() -> str:
    return with_views(f"WITH {PARSED}\nSELECT {_canonical_select()} FROM p WHERE NOT ({_any_error()})", raw=True)


def returns_excluded() -> str:
    codes = ", ".join(f"CASE WHEN {_pred(p)} THEN '{c}' END" for c, s, _col, p in RULES if s == "error")
    reasons = f"array_to_string(list_sort(list_distinct(list_filter([{codes}], lambda x: x IS NOT NULL))), ';')"
    return with_views(
        f"WITH {PARSED}\nSELECT {_canonical_select()}, {reasons} AS Exclusion_Reasons FROM p WHERE {_any_error()}",
        raw=True,
    )


def returns_summary() -> str:
    err = " + ".join(f"CAST({_pred(p)} AS INT)" for _c, s, _col, p in RULES if s == "error")
    warn = " + ".join(f"CAST({_pred(p)} AS INT)" for _c, s, _col, p in RULES if s == "warning")
    body = f"""WITH {PARSED},
a AS (SELECT *, ({_any_error()}) AS bad, ({err}) AS n_err, ({warn}) AS n_warn FROM p)
SELECT count(*) FILTER (WHERE NOT bad) AS total_precincts,
       count(DISTINCT t_j) FILTER (WHERE NOT bad) AS total_jurisdictions,
       round(sum(n_Ballots_Cast) FILTER (WHERE NOT bad), 6) AS ballots_cast,
       round(sum(n_Valid_Contest_Votes) FILTER (WHERE NOT bad), 6) AS valid_contest_votes,
       CAST(sum(n_err) AS BIGINT) AS errors, CAST(sum(n_warn) AS BIGINT) AS warnings,
       count(*) FILTER (WHERE bad) AS excluded_rows, count(*) AS original_rows,
       count(*) FILTER (WHERE NOT bad AND (CASE WHEN n_lat BETWEEN -90 AND 90 THEN n_lat END IS NULL
                                         OR CASE WHEN n_lon BETWEEN -180 AND 180 THEN n_lon END IS NULL)) AS missing_coordinates
FROM a"""
    return with_views(body, raw=True)


# ------------------------------------------------------------------ M1

M1_CORE = """w AS (SELECT Jurisdiction || '::' || Precinct AS Precinct_ID,
                  100.0 * Ballots_Cast / Registered_Voters AS t, {cand} / Valid_Contest_Votes AS s
           FROM returns WHERE Registered_Voters > 0 AND Valid_Contest_Votes > 0
             AND 100.0 * Ballots_Cast / Registered_Voters BETWEEN 0 AND 100),
g AS (SELECT avg(t) c, stddev_pop(t) sd, quantile_cont(t, 0.9) lim, count(*) n FROM w),
z AS (SELECT w.*, (t - c) / sd x, t <= lim ref, g.n, g.lim FROM w, g),
pq AS (SELECT count(*) m, sum(x) sx, sum(x * x) sxx, sum(s) sy, sum(x * s) sxy FROM z WHERE ref),
q AS (SELECT *, m * sxx - sx * sx det, (sxx * sy - sx * sxy) / (m * sxx - sx * sx) b0,
             (m * sxy - sx * sy) / (m * sxx - sx * sx) b1 FROM pq),
r AS (SELECT z.*, q.m, q.b0, q.b1, s - (b0 + b1 * x) res, (sxx - 2 * x * sx + x * x * q.m) / det h FROM z, q),
e AS (SELECT sum(res * res) / (max(m) - 2) mse, max(m) - 2 AS dfree FROM r WHERE ref),
o AS (SELECT r.*, CASE WHEN ref THEN res / (1 - h) ELSE res END AS loo,
             CASE WHEN ref THEN 1 + h / (1 - h) ELSE 1 + h END AS mult, e.mse, e.dfree FROM r, e),
f AS (SELECT *, sqrt(mse * mult) AS se, {crit} AS crit FROM o)"""


def m1_core(cand: str = "Votes_Candidate_A") -> str:
    return M1_CORE.format(cand=cand, crit=t975("dfree"))


def turnout_share() -> str:
    body = f"""WITH {m1_core()}
SELECT rt.Jurisdiction || '::' || rt.Precinct AS Precinct_ID,
       round(f.s - f.loo, 6) AS Turnout_Baseline_Expected_Share,
       round(f.loo, 6) AS Turnout_Share_Residual,
       round(f.loo / f.se, 6) AS Turnout_Share_Studentized_Residual,
       round(f.s - f.loo - f.crit * f.se, 6) AS Turnout_Share_Prediction_Lower,
       round(f.s - f.loo + f.crit * f.se, 6) AS Turnout_Share_Prediction_Upper,
       f.h > 2.0 * 2 / f.n AS Turnout_Share_High_Leverage,
       abs(f.loo / f.se) > 3.0 AS Turnout_Share_Flag
FROM returns rt LEFT JOIN f ON rt.Jurisdiction || '::' || rt.Precinct = f.Precinct_ID"""
    return with_views(body)


def turnout_share_model() -> str:
    body = f"""WITH {m1_core()}
SELECT round(max(lim), 6) AS baseline_turnout_upper_limit, CAST(count(*) FILTER (WHERE ref) AS BIGINT) AS baseline_observations,
       CAST(count(*) AS BIGINT) AS valid_observations, CAST(max(dfree) AS BIGINT) AS residual_degrees_of_freedom,
       round(max(b0), 6) AS intercept, round(max(b1), 6) AS slope,
       CAST(count(*) FILTER (WHERE abs(loo / se) > 3.0) AS BIGINT) AS flagged_observations,
       CAST(count(*) FILTER (WHERE h > 2.0 * 2 / n) AS BIGINT) AS high_leverage_observations,
       round(sum(loo * loo), 6) AS sum_loo_squared, round(max(abs(loo / se)), 6) AS max_abs_studentized
FROM f"""
    return with_views(body)


# ------------------------------------------------------------------ M3 / M5 / M4

PID = "Jurisdiction || '::' || Precinct"
SHARE_A_SQL = "CASE WHEN Valid_Contest_Votes > 0 THEN Votes_Candidate_A / Valid_Contest_Votes END"
TURNOUT_SQL = "CASE WHEN Registered_Voters > 0 THEN Ballots_Cast / Registered_Voters * 100 END"

TREND_CORE = f"""tw AS (SELECT {PID} AS Precinct_ID, CAST(Votes_Candidate_A AS DOUBLE) AS x, {SHARE_A_SQL} AS y FROM returns),
tv AS (SELECT * FROM tw WHERE x IS NOT NULL AND y IS NOT NULL),
ts AS (SELECT count(*) n, regr_slope(y, x) b1, regr_intercept(y, x) b0, regr_r2(y, x) r2 FROM tv)"""


def vote_share_trend() -> str:
    return with_views(f"""WITH {TREND_CORE}
SELECT tw.Precinct_ID,
       round(CASE WHEN tw.y IS NOT NULL AND tw.x IS NOT NULL THEN b0 + b1 * x END, 6) AS Vote_Count_Trend_Expected_Share__candidate_a,
       round(CASE WHEN tw.y IS NOT NULL AND tw.x IS NOT NULL THEN y - (b0 + b1 * x) END, 6) AS Vote_Count_Trend_Residual__candidate_a
FROM tw, ts""")


def vote_share_trend_fit() -> str:
    return with_views(f"""WITH {TREND_CORE}
SELECT CAST(n AS BIGINT) AS valid_observations, round(b1 * 100, 6) AS slope_share_per_100_votes,
       round(b0, 6) AS intercept, round(r2, 6) AS r_squared FROM ts""")


def down_ballot_rows() -> str:
    cols = []
    for cand, down, key in (("Votes_Candidate_A", "Votes_Down_Ballot_A", "candidate_a_down_ballot"),
                            ("Votes_Candidate_B", "Votes_Down_Ballot_B", "candidate_b_down_ballot")):
        ok = f"({cand} > 0 AND {down} IS NOT NULL AND {down} >= 0)"
        cols.append(f"round(CASE WHEN {ok} THEN CAST({cand} - {down} AS DOUBLE) END, 6) AS Down_Ballot_Difference_Votes__{key}")
        cols.append(f"round(CASE WHEN {ok} THEN 100.0 * ({cand} - {down}) / {cand} END, 6) AS Down_Ballot_Difference_Percent__{key}")
    return with_views(f"SELECT {PID} AS Precinct_ID, {', '.join(cols)} FROM returns")


def down_ballot_summary() -> str:
    parts = []
    for cand, down, key in (("Votes_Candidate_A", "Votes_Down_Ballot_A", "candidate_a_down_ballot"),
                            ("Votes_Candidate_B", "Votes_Down_Ballot_B", "candidate_b_down_ballot")):
        parts.append(f"""SELECT '{key}' AS key, count(*) AS valid_observations,
       round(CAST(sum({cand}) - sum({down}) AS DOUBLE), 6) AS aggregate_difference_votes,
       round(100.0 * (sum({cand}) - sum({down})) / sum({cand}), 6) AS aggregate_difference_percent_of_presidential,
       round(quantile_cont(100.0 * ({cand} - {down}) / {cand}, 0.5), 6) AS median_precinct_difference_percent,
       count(*) FILTER (WHERE 100.0 * ({cand} - {down}) / {cand} < 0) AS negative_difference_precincts
FROM returns WHERE {cand} > 0 AND {down} IS NOT NULL AND {down} >= 0""")
    return with_views("\nUNION ALL\n".join(parts))


DIGIT_COLS = ["Votes_Candidate_A", "Votes_Candidate_B", "Votes_Candidate_C"]
BENFORD_COLS = ["Registered_Voters", "Ballots_Cast", "Votes_Candidate_A"]


def _digits_long(cols: list[str]) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS col, CAST({c} AS BIGINT) AS v FROM returns WHERE {c} IS NOT NULL" for c in cols)


def last_digit_counts() -> str:
    return with_views(f"""WITH d AS ({_digits_long(DIGIT_COLS)}),
cols AS (SELECT DISTINCT col FROM d), digits AS (SELECT CAST(range AS INTEGER) AS digit FROM range(10)),
c AS (SELECT col, CAST(abs(v) % 10 AS INTEGER) AS digit, count(*) AS n FROM d GROUP BY ALL)
SELECT cols.col AS "column", digits.digit, coalesce(c.n, 0) AS n
FROM cols CROSS JOIN digits LEFT JOIN c ON c.col = cols.col AND c.digit = digits.digit""")


def last_digit_chi2() -> str:
    return with_views(f"""WITH d AS ({_digits_long(DIGIT_COLS)}),
c AS (SELECT col, abs(v) % 10 AS digit, count(*) AS n FROM d GROUP BY ALL),
t AS (SELECT col, sum(n) AS total FROM c GROUP BY col)
SELECT c.col AS "column", CAST(max(t.total) AS BIGINT) AS n,
       round(sum((n - t.total / 10.0) * (n - t.total / 10.0) / (t.total / 10.0)) + (10 - count(*)) * max(t.total) / 10.0, 6) AS statistic
FROM c JOIN t USING (col) GROUP BY c.col""")


def benford_counts() -> str:
    return with_views(f"""WITH d AS ({_digits_long(BENFORD_COLS)}),
cols AS (SELECT DISTINCT col FROM d), digits AS (SELECT CAST(range AS INTEGER) AS digit FROM range(1, 10)),
c AS (SELECT col, CAST(substr(CAST(v AS VARCHAR), 1, 1) AS INTEGER) AS digit, count(*) AS n FROM d WHERE v > 0 GROUP BY ALL)
SELECT cols.col AS "column", digits.digit, coalesce(c.n, 0) AS n
FROM cols CROSS JOIN digits LEFT JOIN c ON c.col = cols.col AND c.digit = digits.digit""")


def benford_chi2() -> str:
    return with_views(f"""WITH d AS ({_digits_long(BENFORD_COLS)}),
p AS (SELECT col, v FROM d WHERE v > 0),
s AS (SELECT col, count(*) AS n, log10(max(v)) - log10(min(v)) AS orders FROM p GROUP BY col),
digits AS (SELECT CAST(range AS INTEGER) AS digit FROM range(1, 10)),
c AS (SELECT col, CAST(substr(CAST(v AS VARCHAR), 1, 1) AS INTEGER) AS digit, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT s.col, digits.digit, coalesce(c.n, 0) AS o, s.n * log10(1 + 1.0 / digits.digit) AS e
      FROM s CROSS JOIN digits LEFT JOIN c ON c.col = s.col AND c.digit = digits.digit)
SELECT s.col AS "column", s.n AS n_positive, round(s.orders, 6) AS orders_of_magnitude,
       round(sum((o - e) * (o - e) / e), 6) AS statistic, s.n >= 100 AND s.orders >= 2 AS meets_preconditions
FROM g JOIN s USING (col) GROUP BY s.col, s.n, s.orders""")


def round_number() -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) % 10 = 0 AS Round_Number_Multiple_10__{c}" for c in DIGIT_COLS)
    return with_views(f"SELECT {PID} AS Precinct_ID, {cols} FROM returns")


def holm_adjusted() -> str:
    return with_views(f"""WITH t AS (SELECT {PID} AS Precinct_ID, Jurisdiction, {SHARE_A_SQL} AS p FROM returns),
r AS (SELECT *, row_number() OVER (PARTITION BY Jurisdiction ORDER BY p, Precinct_ID) AS j,
             count(*) OVER (PARTITION BY Jurisdiction) AS m FROM t WHERE p IS NOT NULL)
SELECT Precinct_ID, Jurisdiction, round(p, 6) AS p,
       round(max(least(1.0, p * (m - j + 1))) OVER (PARTITION BY Jurisdiction ORDER BY j ROWS UNBOUNDED PRECEDING), 6) AS holm
FROM r""")


def bh_adjusted() -> str:
    return with_views(f"""WITH t AS (SELECT {PID} AS Precinct_ID, {SHARE_A_SQL} AS p FROM returns),
r AS (SELECT *, row_number() OVER (ORDER BY p, Precinct_ID) AS j, count(*) OVER () AS m FROM t WHERE p IS NOT NULL)
SELECT Precinct_ID, round(p, 6) AS p,
       round(least(1.0, min(p * m / j) OVER (ORDER BY j DESC ROWS UNBOUNDED PRECEDING)), 6) AS bh
FROM r""")


# ------------------------------------------------------------------ A3, A6-A8, F, G

def turnout_histogram() -> str:
    return with_views(f"""WITH t AS (SELECT {TURNOUT_SQL} AS t, CAST(Votes_Candidate_A AS DOUBLE) a,
                  CAST(Votes_Candidate_B AS DOUBLE) b, CAST(Votes_Candidate_C AS DOUBLE) c FROM returns),
v AS (SELECT * FROM t WHERE t IS NOT NULL),
s AS (SELECT min(t) lo, max(t) hi, (max(t) - min(t)) / 25 w FROM v),
b AS (SELECT CAST(least(greatest(ceil((t - lo) / w) - 1, 0), 24) AS INTEGER) AS bin, a, b, c FROM v, s),
g AS (SELECT bin, sum(a) a, sum(b) b, sum(c) c FROM b GROUP BY bin),
axis AS (SELECT CAST(range AS INTEGER) AS bin FROM range(25)),
e AS (SELECT axis.bin, lo + axis.bin * w AS lower, CASE WHEN axis.bin = 24 THEN hi ELSE lo + (axis.bin + 1) * w END AS upper,
             coalesce(g.a, 0) a, coalesce(g.b, 0) b, coalesce(g.c, 0) c FROM axis CROSS JOIN s LEFT JOIN g ON g.bin = axis.bin)
SELECT bin, round(lower, 6) AS bin_lower, round(upper, 6) AS bin_upper, round((lower + upper) / 2, 6) AS bin_center,
       round(a, 6) AS Votes_Candidate_A, round(b, 6) AS Votes_Candidate_B, round(c, 6) AS Votes_Candidate_C FROM e""")


DIST_COLS = {"Registered_Voters": "CAST(Registered_Voters AS DOUBLE)", "Ballots_Cast": "CAST(Ballots_Cast AS DOUBLE)",
             "Valid_Contest_Votes": "CAST(Valid_Contest_Votes AS DOUBLE)", "Calculated_Turnout_Percent": TURNOUT_SQL}


def distribution_bins() -> str:
    longs = "\nUNION ALL\n".join(f"SELECT '{c}' AS col, {e} AS x FROM returns" for c, e in DIST_COLS.items())
    return with_views(f"""WITH l AS ({longs}), v AS (SELECT * FROM l WHERE x IS NOT NULL),
s AS (SELECT col, min(x) lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 20 ELSE 1.0 END w FROM v GROUP BY col),
b AS (SELECT v.col, CAST(least(greatest(ceil((x - lo) / w) - 1, 0), 19) AS INTEGER) AS bin, lo, w FROM v JOIN s USING (col))
SELECT col AS "column", bin, round(lo + bin * w, 6) AS bin_lower, round(lo + (bin + 1) * w, 6) AS bin_upper, count(*) AS n
FROM b GROUP BY col, bin, lo, w""")


CORR_COLS = {"Calculated_Turnout_Percent": TURNOUT_SQL, "Candidate_Share__candidate_a": SHARE_A_SQL,
             "Candidate_Share__candidate_b": "CASE WHEN Valid_Contest_Votes > 0 THEN Votes_Candidate_B / Valid_Contest_Votes END",
             "Ballots_Cast": "CAST(Ballots_Cast AS DOUBLE)", "Registered_Voters": "CAST(Registered_Voters AS DOUBLE)"}


def correlation_matrix() -> str:
    sel = ", ".join(f"{e} AS {c}" for c, e in CORR_COLS.items())
    parts = [f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM t"
             for a in CORR_COLS for b in CORR_COLS]
    return with_views(f"WITH t AS (SELECT {sel} FROM returns)\n" + "\nUNION ALL\n".join(parts))


def flag_counts() -> str:
    return with_views(f"""WITH {m1_core()}
SELECT 'Turnout_Share_Flag' AS flag_column, count(*) FILTER (WHERE abs(loo / se) > 3.0) AS flagged FROM f
UNION ALL
SELECT 'Turnout_Share_High_Leverage', count(*) FILTER (WHERE h > 2.0 * 2 / n) FROM f""")


SCOPE_J = ("NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_8", "NATION_13")


def scope_filter() -> str:
    js = ", ".join(f"'{j}'" for j in SCOPE_J)
    return with_views(f"""SELECT {PID} AS Precinct_ID, Jurisdiction, round({TURNOUT_SQL}, 6) AS Calculated_Turnout_Percent,
       CAST(Ballots_Cast AS DOUBLE) AS Ballots_Cast FROM returns
WHERE Jurisdiction IN ({js}) AND {TURNOUT_SQL} BETWEEN 40 AND 80 AND Ballots_Cast >= 100""")


def scope_vote_type() -> str:
    return with_views(f"""SELECT {PID} || '::' || Vote_Type AS Precinct_ID, Vote_Type, CAST(Ballots_Cast AS DOUBLE) AS Ballots_Cast
FROM returns WHERE Vote_Type IN ('1-URGENT', '2-HIGH')""", by_type=True)


def turnout_bounds() -> str:
    return with_views(f"SELECT round(min({TURNOUT_SQL}), 6) AS turnout_min, round(max({TURNOUT_SQL}), 6) AS turnout_max FROM returns")


def jurisdiction_list() -> str:
    return with_views("SELECT DISTINCT Jurisdiction FROM returns")


def flagged_records() -> str:
    return with_views(f"""WITH {m1_core()}
SELECT Precinct_ID, round(loo / se, 6) AS Turnout_Share_Studentized_Residual FROM f WHERE abs(loo / se) > 3.0""")


def chart_scatter() -> str:
    return with_views(f"""WITH {m1_core()}
SELECT round({TURNOUT_SQL}, 6) AS turnout, round({SHARE_A_SQL}, 6) AS share, rt.Jurisdiction, rt.Precinct,
       coalesce(abs(f.loo / f.se) > 3.0, false) AS flagged, round(f.s - f.loo, 6) AS expected_share
FROM returns rt LEFT JOIN f ON rt.Jurisdiction || '::' || rt.Precinct = f.Precinct_ID
WHERE {TURNOUT_SQL} IS NOT NULL AND {SHARE_A_SQL} IS NOT NULL""")


def chart_residual() -> str:
    return with_views(f"""WITH {m1_core()}
SELECT round(t, 6) AS turnout, round(loo, 6) AS residual, round(crit * se, 6) AS upper_band, round(-crit * se, 6) AS lower_band FROM f""")


def chart_trend() -> str:
    return with_views(f"""WITH {TREND_CORE}
SELECT round(x, 6) AS votes, round(y, 6) AS share, round(b0 + b1 * x, 6) AS trend_share FROM tv, ts""")


def chart_down_ballot() -> str:
    ok = "(Votes_Candidate_A > 0 AND Votes_Down_Ballot_A IS NOT NULL AND Votes_Down_Ballot_A >= 0)"
    return with_views(f"""SELECT CAST(Votes_Candidate_A AS DOUBLE) AS presidential_votes,
       round(100.0 * (Votes_Candidate_A - Votes_Down_Ballot_A) / Votes_Candidate_A, 6) AS difference_percent
FROM returns WHERE {ok}""")


def chart_map() -> str:
    return with_views(f"""SELECT round(Latitude, 6) AS Latitude, round(Longitude, 6) AS Longitude, round({SHARE_A_SQL}, 6) AS value,
       Jurisdiction || ' - ' || Precinct AS label, CASE WHEN {SHARE_A_SQL} >= 0.8 THEN 'highlighted' ELSE 'normal' END AS marker_class
FROM returns WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL AND {SHARE_A_SQL} IS NOT NULL""")


def map_center() -> str:
    return with_views(f"""SELECT round(avg(Latitude), 6) AS center_latitude, round(avg(Longitude), 6) AS center_longitude, count(*) AS points
FROM returns WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL AND {SHARE_A_SQL} IS NOT NULL""")


# ------------------------------------------------------------------ M9 / M10

def _feature_base() -> tuple[str, list[str]]:
    shares = {k: f"CASE WHEN Valid_Contest_Votes > 0 THEN {c} / Valid_Contest_Votes END" for c, k in SHARES.items()}
    items = [("turnout_fraction", f"({TURNOUT_SQL}) / 100")]
    items += [(f"Candidate_Share__{k}", e) for k, e in shares.items()]
    items += [(f"log1p__{c}", f"ln(1 + CAST({c} AS DOUBLE))") for c in ("Registered_Voters", "Ballots_Cast", "Valid_Contest_Votes")]
    items += [("contest_vote_rate", "CASE WHEN Ballots_Cast > 0 THEN Valid_Contest_Votes / Ballots_Cast END")]
    items += [(f"rate__{c}", f"CASE WHEN Ballots_Cast > 0 THEN {c} / Ballots_Cast END") for c in ("Undervotes", "Overvotes", "Write_In_Votes")]
    sel = ", ".join(f"{e} AS {n}" for n, e in items)
    return f"SELECT {PID} AS Precinct_ID, Jurisdiction AS j, Latitude AS lat, Longitude AS lon, {sel} FROM returns", [n for n, _ in items]


def _feature_sql() -> tuple[str, list[str]]:
    base, names = _feature_base()
    z = ", ".join(
        f"(b.{n} - avg(b.{n}) OVER w) / CASE WHEN stddev_samp(b.{n}) OVER w > 0 THEN stddev_samp(b.{n}) OVER w END AS jurisdiction_z__{n}"
        for n in names
    )
    dist = "sqrt(pow(lat - avg(lat) OVER w, 2) + pow(lon - avg(lon) OVER w, 2)) AS distance_from_jurisdiction_centroid"
    allnames = names + ["distance_from_jurisdiction_centroid"] + [f"jurisdiction_z__{n}" for n in names]
    return f"fb AS ({base}),\nft AS (SELECT b.*, {dist}, {z} FROM fb b WINDOW w AS (PARTITION BY j))", allnames


def features() -> str:
    cte, names = _feature_sql()
    return with_views(f"WITH {cte}\nSELECT Precinct_ID, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + " FROM ft")


def features_scaled() -> str:
    cte, names = _feature_sql()
    med = ", ".join(f"quantile_cont({n}, 0.5) AS m_{n}" for n in names)
    fill = ", ".join(f"coalesce({n}, m_{n}) AS {n}" for n in names)
    qs = ", ".join(f"quantile_cont({n}, 0.25) AS a_{n}, quantile_cont({n}, 0.5) AS c_{n}, quantile_cont({n}, 0.75) AS b_{n}" for n in names)
    out = ", ".join(f"round(({n} - c_{n}) / CASE WHEN b_{n} - a_{n} = 0 THEN 1.0 ELSE b_{n} - a_{n} END, 6) AS {n}" for n in names)
    return with_views(f"""WITH {cte},
med AS (SELECT {med} FROM ft),
fl AS (SELECT Precinct_ID, {fill} FROM ft, med),
q AS (SELECT {qs} FROM fl)
SELECT Precinct_ID, {out} FROM fl, q""")


# ------------------------------------------------------------------ M6-M8

KNN_CORE = f"""nd AS (SELECT {PID} AS id, Longitude AS x, Latitude AS y, {SHARE_A_SQL} AS v FROM returns
          WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL AND {SHARE_A_SQL} IS NOT NULL),
kk AS (SELECT least(8, count(*) - 1) AS k FROM nd),
pr AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist,
              row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS r
       FROM nd a JOIN nd b ON a.id <> b.id),
ed AS (SELECT src, dst, dist FROM pr, kk WHERE r <= k),
zz AS (SELECT id, v - avg(v) OVER () AS z FROM nd),
lg AS (SELECT ed.src, avg(zz.z) AS lag FROM ed JOIN zz ON zz.id = ed.dst GROUP BY ed.src),
mo AS (SELECT zz.id, zz.z, coalesce(lg.lag, 0) AS lag, sum(zz.z * zz.z) OVER () AS s2, count(*) OVER () AS n
       FROM zz LEFT JOIN lg ON lg.src = zz.id)"""


def knn_edges() -> str:
    return with_views(f"WITH {KNN_CORE}\nSELECT src, dst, round(dist, 6) AS dist FROM ed")


def moran_global() -> str:
    return with_views(f"""WITH {KNN_CORE}
SELECT CAST(max(n) AS BIGINT) AS valid_observations, round(sum(z * lag) / max(s2), 6) AS global_moran_i,
       round(-1.0 / (max(n) - 1), 6) AS global_expected_i FROM mo""")


def moran_local() -> str:
    return with_views(f"""WITH {KNN_CORE}
SELECT id AS Precinct_ID, round(z * lag / (s2 / n), 6) AS Local_Moran_I,
       CASE WHEN z >= 0 AND lag >= 0 THEN 'high-high cluster' WHEN z < 0 AND lag < 0 THEN 'low-low cluster'
            WHEN z >= 0 AND lag < 0 THEN 'high-low spatial outlier' ELSE 'low-high spatial outlier' END AS Spatial_Pattern
FROM mo""")


def _images(rounds: int = 16) -> str:
    """FROM text: images x of the indexes i under permutations p (swap-or-not rounds over the keys ``ky``)."""
    rows = "SELECT t.p, idx AS i, idx AS x FROM ix, range(999) t(p)"
    for r in range(rounds):
        paired = f"SELECT a.p, a.i, a.x, k.c, k.n, (k.k - a.x + k.n) % k.n AS o FROM ({rows}) a JOIN ky k ON k.p = a.p AND k.r = {r}"
        first = f"SELECT p, i, x, o, ((greatest(x, o) + c) & 1073741823) * 2654435761 & 4294967295 AS h FROM ({paired})"
        second = f"SELECT p, i, x, o, (xor(h, h >> 16) & 1073741823) * 2246822507 & 4294967295 AS h FROM ({first})"
        rows = f"SELECT p, i, CASE WHEN (h >> 17) & 1 = 1 THEN o ELSE x END AS x FROM ({second})"
    return rows


def moran_permutation() -> str:
    """999 keyed permutations, seed 42; exceedances per node and overall."""
    return with_views(f"""WITH {KNN_CORE},
ix AS MATERIALIZED (SELECT id, z, row_number() OVER (ORDER BY id) - 1 AS idx, z * lag / (s2 / n) AS li, s2, n FROM mo),
kd AS (SELECT p, r, md5('42:' || p || ':' || r) AS d FROM range(999) a(p), range(16) b(r)),
ky AS MATERIALIZED (SELECT p, r, (SELECT max(n) FROM ix) AS n, CAST('0x' || substr(d, 1, 15) AS BIGINT) % (SELECT max(n) FROM ix) AS k, CAST('0x' || substr(d, 16, 7) AS BIGINT) AS c FROM kd),
im AS ({_images()}),
dr AS MATERIALIZED (SELECT im.p, im.i AS pos, ix.z FROM im JOIN ix ON ix.idx = im.x),
ei AS (SELECT a.idx AS src, b.idx AS dst, 1.0 / count(*) OVER (PARTITION BY ed.src) AS w FROM ed JOIN ix a ON a.id = ed.src JOIN ix b ON b.id = ed.dst),
pl AS MATERIALIZED (SELECT ei.src, dr.p, sum(ei.w * dr.z) AS lag FROM ei JOIN dr ON dr.pos = ei.dst GROUP BY ALL),
gp AS (SELECT pl.p, sum(pl.lag * dr.z) AS t FROM pl JOIN dr ON dr.p = pl.p AND dr.pos = pl.src GROUP BY pl.p),
gi AS (SELECT sum(z * lag) / max(s2) AS g FROM mo),
gx AS (SELECT (count(*) + 1) / 1000.0 AS gp FROM gp, gi WHERE abs(gp.t / (SELECT max(s2) FROM mo)) >= abs(g) * (1 - 1e-9)),
ct AS (SELECT ix.id, ix.li, (count(*) FILTER (abs(ix.z * pl.lag / (ix.s2 / ix.n)) >= abs(ix.li) * (1 - 1e-9)) + 1) / 1000.0 AS rp
       FROM ix JOIN pl ON pl.src = ix.idx GROUP BY ix.id, ix.li),
rk AS (SELECT *, row_number() OVER (ORDER BY rp) AS r, count(*) OVER () AS m FROM ct),
bh AS (SELECT *, least(min(rp * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS ap FROM rk),
ad AS (SELECT *, min(ap) OVER (PARTITION BY rp) AS a FROM bh)
SELECT id AS Precinct_ID, round(li, 6) AS Local_Moran_I, round(rp, 6) AS Local_Moran_Raw_P, round(a, 6) AS Local_Moran_Adjusted_P,
       a < 0.05 AS Spatial_Significant, round((SELECT g FROM gi), 6) AS global_moran_i, round((SELECT gp FROM gx), 6) AS global_permutation_p
FROM ad""")


def _polygon_sql(cond: str) -> str:
    return with_views(f"""WITH g AS (SELECT {PID} AS id, k % 40 AS gx, k // 40 AS gy FROM returns),
e AS (SELECT a.id AS src, b.id AS dst FROM g a JOIN g b ON a.id <> b.id AND {cond})
SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY src), 6) AS w FROM e""")


def polygon_queen() -> str:
    return _polygon_sql("abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1")


def polygon_rook() -> str:
    return _polygon_sql("abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1")


# ------------------------------------------------------------------ M12 / A9

DBSCAN_EPS, DBSCAN_MIN = 0.1, 5

DBSCAN_CORE = f"""pts AS (SELECT {PID} AS id, Latitude AS a, Longitude AS b FROM returns WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL),
nb AS (SELECT p.id AS src, q.id AS dst FROM pts p JOIN pts q
       ON abs(p.a - q.a) <= {DBSCAN_EPS} AND abs(p.b - q.b) <= {DBSCAN_EPS}
       AND sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) <= {DBSCAN_EPS}),
core AS (SELECT src AS id FROM nb GROUP BY src HAVING count(*) >= {DBSCAN_MIN}),
ce AS (SELECT nb.src, nb.dst FROM nb JOIN core c1 ON c1.id = nb.src JOIN core c2 ON c2.id = nb.dst),
reach(id, lab) AS (SELECT id, id FROM core UNION SELECT ce.dst, reach.lab FROM reach JOIN ce ON ce.src = reach.id),
comp AS (SELECT id, min(lab) AS lab FROM reach GROUP BY id),
border AS (SELECT nb.src AS id, min(comp.lab) AS lab FROM nb JOIN comp ON comp.id = nb.dst
           WHERE nb.src NOT IN (SELECT id FROM core) GROUP BY nb.src),
lab AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
num AS (SELECT lab, dense_rank() OVER (ORDER BY lab) - 1 AS cluster FROM (SELECT DISTINCT lab FROM comp)),
res AS (SELECT pts.id, coalesce(num.cluster, -1) AS cluster, pts.a, pts.b FROM pts LEFT JOIN lab ON lab.id = pts.id LEFT JOIN num ON num.lab = lab.lab)"""


def dbscan_labels() -> str:
    return with_views(f"""WITH RECURSIVE {DBSCAN_CORE}
SELECT id AS Precinct_ID, CAST(cluster AS BIGINT) AS DBSCAN_Cluster, cluster = -1 AS DBSCAN_Noise_Flag FROM res""")


def cluster_profile() -> str:
    return with_views(f"""WITH RECURSIVE {DBSCAN_CORE}
SELECT CAST(cluster AS BIGINT) AS DBSCAN_Cluster, count(*) AS size, round(CAST(sum(CAST(a AS DECIMAL(38,12))) AS DOUBLE) / count(a), 6) AS Latitude,
       round(CAST(sum(CAST(b AS DECIMAL(38,12))) AS DOUBLE) / count(b), 6) AS Longitude
FROM res WHERE cluster >= 0 GROUP BY cluster""")


# ------------------------------------------------------------------ more coverage

def turnout_share_by_type() -> str:
    core = m1_core().replace(f"SELECT {PID} AS Precinct_ID", f"SELECT {PID} || '::' || Vote_Type AS Precinct_ID", 1)
    core = core.replace("w AS (SELECT Jurisdiction || '::' || Precinct AS Precinct_ID",
                        "w AS (SELECT Jurisdiction || '::' || Precinct || '::' || Vote_Type AS Precinct_ID", 1)
    body = f"""WITH {core}
SELECT rt.Jurisdiction || '::' || rt.Precinct || '::' || rt.Vote_Type AS Precinct_ID,
       round(f.loo, 6) AS Turnout_Share_Residual, round(f.loo / f.se, 6) AS Turnout_Share_Studentized_Residual,
       abs(f.loo / f.se) > 3.0 AS Turnout_Share_Flag
FROM returns rt LEFT JOIN f ON rt.Jurisdiction || '::' || rt.Precinct || '::' || rt.Vote_Type = f.Precinct_ID"""
    return with_views(body, by_type=True)


def polygon_moran() -> str:
    return with_views(f"""WITH g AS (SELECT {PID} AS id, k % 40 AS gx, k // 40 AS gy, {SHARE_A_SQL} AS v FROM returns),
e AS (SELECT a.id AS src, b.id AS dst FROM g a JOIN g b ON a.id <> b.id AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1),
zz AS (SELECT id, v - avg(v) OVER () AS z FROM g WHERE v IS NOT NULL),
lg AS (SELECT e.src, avg(zz.z) AS lag FROM e JOIN zz ON zz.id = e.dst GROUP BY e.src),
mo AS (SELECT zz.id, zz.z, coalesce(lg.lag, 0) AS lag, sum(zz.z * zz.z) OVER () AS s2, count(*) OVER () AS n
       FROM zz LEFT JOIN lg ON lg.src = zz.id)
SELECT id AS Precinct_ID, round(z * lag / (s2 / n), 6) AS Local_Moran_I,
       CASE WHEN z >= 0 AND lag >= 0 THEN 'high-high cluster' WHEN z < 0 AND lag < 0 THEN 'low-low cluster'
            WHEN z >= 0 AND lag < 0 THEN 'high-low spatial outlier' ELSE 'low-high spatial outlier' END AS Spatial_Pattern
FROM mo""")


def binned_scatter() -> str:
    return with_views(f"""WITH t AS (SELECT {TURNOUT_SQL} AS x, {SHARE_A_SQL} AS y FROM returns),
v AS (SELECT * FROM t WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT min(x) x0, (max(x) - min(x)) / 50 wx, min(y) y0, (max(y) - min(y)) / 50 wy FROM t)
SELECT CAST(least(greatest(ceil((x - x0) / wx) - 1, 0), 49) AS INTEGER) AS x_bin,
       CAST(least(greatest(ceil((y - y0) / wy) - 1, 0), 49) AS INTEGER) AS y_bin, count(*) AS n
FROM v, s GROUP BY ALL""")


def returns_preview() -> str:
    return with_views(f"""WITH {PARSED}
SELECT {_canonical_select()} FROM p WHERE NOT ({_any_error()}) ORDER BY Precinct_ID LIMIT 25""", raw=True)


def validation_status() -> str:
    body = f"""WITH {PARSED},
a AS (SELECT ({_any_error()}) AS bad FROM p)
SELECT CASE WHEN count(*) FILTER (WHERE bad) = 0 THEN 'valid' ELSE 'valid_with_exclusions' END AS status,
       count(*) AS original_rows, count(*) FILTER (WHERE NOT bad) AS accepted_rows, count(*) FILTER (WHERE bad) AS excluded_rows
FROM a"""
    return with_views(body, raw=True)


# ------------------------------------------------------------------ digit tests, layouts, CSV

def digit_tests() -> str:
    """Chi-square tails as 1 - P(df / 2, x / 2), the lower gamma ratio by its power series; Holm over the tests that ran."""
    cols = DIGIT_COLS + BENFORD_COLS[:2]
    return with_views(f"""WITH d AS ({_digits_long(cols)}),
ln AS (SELECT col, count(*) AS n FROM d GROUP BY col),
lc AS (SELECT col, abs(v) % 10 AS digit, count(*) AS o FROM d GROUP BY ALL),
lt AS (SELECT ln.col, n, sum(coalesce(o, 0) * coalesce(o, 0)) * 10.0 / n - n AS x FROM ln CROSS JOIN range(10) g(digit)
       LEFT JOIN lc ON lc.col = ln.col AND lc.digit = g.digit GROUP BY ln.col, n),
p AS (SELECT col, v FROM d WHERE v > 0),
bn AS (SELECT col, count(*) AS n, log10(max(v)) - log10(min(v)) AS orders FROM p GROUP BY col),
bc AS (SELECT col, CAST(substr(CAST(v AS VARCHAR), 1, 1) AS INTEGER) AS digit, count(*) AS o FROM p GROUP BY ALL),
bt AS (SELECT bn.col, n, orders, sum((coalesce(o, 0) - n * log10(1 + 1.0 / g.digit)) ** 2 / (n * log10(1 + 1.0 / g.digit))) AS x
       FROM bn CROSS JOIN range(1, 10) g(digit) LEFT JOIN bc ON bc.col = bn.col AND bc.digit = g.digit GROUP BY ALL),
t AS (SELECT col, 'last_digit_uniformity' AS test, n >= 30 AS ran, x, 4.5 AS a FROM lt
      UNION ALL SELECT bt.col, 'benford_first_digit', bt.n >= 100 AND orders >= 2, bt.x, 4.0 FROM bt JOIN ln ON ln.col = bt.col AND ln.n >= 30),
pv AS (SELECT col, test, x, CASE WHEN x > 1000 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(2000), lambda k: exp((a + k) * ln(x / 2) - lgamma(a + k + 1) - x / 2)))) END AS pr
       FROM t WHERE ran),
rk AS (SELECT *, row_number() OVER (ORDER BY pr) AS r, count(*) OVER () AS m FROM pv),
ho AS (SELECT *, least(max((m - r + 1) * pr) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 1.0) AS adj FROM rk)
SELECT t.col AS "column", t.test, CASE WHEN t.ran THEN 'successful' ELSE 'unavailable' END AS status, round(ho.x, 6) AS statistic,
       round(ho.pr, 6) AS p_value, round(ho.adj, 6) AS adjusted_p_value, ho.adj < 0.05 AS significant
FROM t LEFT JOIN ho ON ho.col = t.col AND ho.test = t.test""")


def alternate_layout() -> str:
    return with_views("""SELECT Jurisdiction || '::' || Precinct AS Precinct_ID, Jurisdiction, 'old' AS Source_Original__Jurisdiction,
       CAST(Registered_Voters AS DOUBLE) AS Registered_Voters, CAST(Valid_Contest_Votes AS DOUBLE) AS Ballots_Cast,
       CAST(Valid_Contest_Votes AS DOUBLE) AS Valid_Contest_Votes, round(Latitude, 6) AS Latitude, round(Longitude, 6) AS Longitude,
       round(Valid_Contest_Votes / Registered_Voters * 100, 6) AS Reported_Turnout_Percent,
       round(Valid_Contest_Votes / Registered_Voters * 100, 6) AS Calculated_Turnout_Percent,
       round(CASE WHEN Valid_Contest_Votes > 0 THEN Votes_Candidate_A / Valid_Contest_Votes END, 6) AS Candidate_Share__harris,
       round(CASE WHEN Valid_Contest_Votes > 0 THEN Votes_Candidate_B / Valid_Contest_Votes END, 6) AS Candidate_Share__trump,
       'legacy_harris_trump' AS layout, 2 AS file_issues
FROM returns""")


def csv_round_trip() -> str:
    return with_views("""SELECT Jurisdiction, Precinct, CAST(Valid_Contest_Votes AS DOUBLE) AS Valid_Contest_Votes,
       CAST(Votes_Candidate_A AS DOUBLE) AS Votes_Candidate_A, CAST(Votes_Candidate_B AS DOUBLE) AS Votes_Candidate_B,
       'say "' || Precinct || '",' || chr(10) || 'then a line' AS note, 'utf-8' AS encodings
FROM returns""")


def bundle_round_trip() -> str:
    return with_views(f"""WITH {m1_core()},
fl AS (SELECT rt.Jurisdiction || '::' || rt.Precinct AS Precinct_ID, round(f.loo, 6) AS Turnout_Share_Residual, round(f.loo / f.se, 6) AS Turnout_Share_Studentized_Residual,
       f.h > 2.0 * 2 / f.n AS Turnout_Share_High_Leverage, abs(f.loo / f.se) > 3.0 AS Turnout_Share_Flag
       FROM returns rt LEFT JOIN f ON rt.Jurisdiction || '::' || rt.Precinct = f.Precinct_ID)
SELECT *, count(*) OVER () AS validated_input, CAST(0 AS BIGINT) AS excluded_records, count(*) FILTER (Turnout_Share_Flag) OVER () AS flagged_diagnostics FROM fl""")


def csv_file_issues() -> str:
    return with_views("""WITH j AS (SELECT CAST(regexp_extract(Jurisdiction, '([0-9]+)$', 1) AS INTEGER) AS no, count(*) AS n FROM returns GROUP BY 1)
SELECT no, 'duplicate_columns' AS code, 'named more than once: Precinct' AS message FROM j WHERE no % 5 = 1
UNION ALL SELECT no, 'unsupported_column_mapping', 'not in the header: Valid_Contest_Votes' FROM j WHERE no % 5 IN (1, 2)
UNION ALL SELECT no, 'malformed_csv', n || ' rows with more fields than the header' FROM j WHERE no % 5 = 3
UNION ALL SELECT no, 'empty_dataset', 'a header without rows' FROM j WHERE no % 5 = 4""")


def file_digests() -> str:
    return with_views("""WITH l AS (SELECT CAST(regexp_extract(Jurisdiction, '([0-9]+)$', 1) AS INTEGER) AS no,
       concat_ws(',', Jurisdiction, Precinct, Valid_Contest_Votes, Votes_Candidate_A) || chr(10) AS line FROM returns),
t AS (SELECT no, string_agg(line, '' ORDER BY line) AS content FROM l GROUP BY no)
SELECT no, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS sha256 FROM t""")


def issue_preview() -> str:
    inner = returns_issues()
    return f"SELECT * FROM ({inner}) ORDER BY Precinct_ID NULLS FIRST, code, \"column\" NULLS FIRST LIMIT 50"
