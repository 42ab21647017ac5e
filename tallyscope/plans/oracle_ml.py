"""DuckDB oracle SQL of the queries over the scaled feature matrix: DBSCAN, forest, importance, scoring.

The forest is rebuilt level by level from the same integer hashes (independent re-statement in SQL).
"""

from __future__ import annotations

from ..sources.fixtures import returns_sql, with_views
from .oracle_sql import PID, _feature_sql

TREES, PSI, DEPTH, SEED = 200, 256, 8, 42
LOW, WORD, FIRST, SECOND = (1 << 30) - 1, (1 << 32) - 1, 0x9E3779B1, 0x85EBCA6B


def _quoted(names: list[str]) -> str:
    return ", ".join(names)


def _scaled(source: str = "ft", out: str = "sc") -> str:
    """CTEs: the fitted quantiles of ``ft`` (once) and ``source`` scaled by them."""
    _, names = _feature_sql()
    med = ", ".join(f"quantile_cont({n}, 0.5) AS m_{n}" for n in names)
    fill = ", ".join(f"coalesce({n}, m_{n}) AS {n}" for n in names)
    qs = ", ".join(f"quantile_cont({n}, 0.25) AS a_{n}, quantile_cont({n}, 0.5) AS c_{n}, quantile_cont({n}, 0.75) AS b_{n}" for n in names)
    scale = ", ".join(f"(coalesce({n}, m_{n}) - c_{n}) / CASE WHEN b_{n} - a_{n} = 0 THEN 1.0 ELSE b_{n} - a_{n} END AS {n}" for n in names)
    fitted = f"md AS (SELECT {med} FROM ft),\nqt AS (SELECT {qs} FROM (SELECT {fill} FROM ft, md)),\n" if source == "ft" else ""
    return f"{fitted}{out} AS MATERIALIZED (SELECT Precinct_ID AS id, {scale} FROM {source}, qt, md)"


def _long(source: str, out: str) -> str:
    """CTE of (id, f, v) rows, features numbered in their order."""
    _, names = _feature_sql()
    return f"{out} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT id, {i} AS f, {n} AS v FROM {source}" for i, n in enumerate(names)) + ")"


def dbscan_features(eps: float = 1.5, least: int = 5) -> str:
    cte, names = _feature_sql()
    total = " + ".join(f"(p.{n} - q.{n}) * (p.{n} - q.{n})" for n in names)
    return with_views(f"""WITH RECURSIVE {cte},
{_scaled()},
nb AS MATERIALIZED (SELECT p.id AS src, q.id AS dst FROM sc p JOIN sc q ON abs(p.{names[0]} - q.{names[0]}) <= {eps} AND sqrt({total}) <= {eps}),
core AS MATERIALIZED (SELECT src AS id FROM nb GROUP BY src HAVING count(*) >= {least}),
ce AS MATERIALIZED (SELECT nb.src, nb.dst FROM nb JOIN core c1 ON c1.id = nb.src JOIN core c2 ON c2.id = nb.dst),
reach(id, lab) AS (SELECT id, id FROM core UNION SELECT ce.dst, reach.lab FROM reach JOIN ce ON ce.src = reach.id),
comp AS (SELECT id, min(lab) AS lab FROM reach GROUP BY id),
border AS (SELECT nb.src AS id, min(comp.lab) AS lab FROM nb JOIN comp ON comp.id = nb.dst WHERE nb.src NOT IN (SELECT id FROM core) GROUP BY nb.src),
lab AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
num AS (SELECT lab, dense_rank() OVER (ORDER BY lab) - 1 AS cluster FROM (SELECT DISTINCT lab FROM comp)),
res AS (SELECT sc.id, coalesce(num.cluster, -1) AS cluster FROM sc LEFT JOIN lab ON lab.id = sc.id LEFT JOIN num ON num.lab = lab.lab)
SELECT id AS Precinct_ID, CAST(cluster AS BIGINT) AS DBSCAN_Cluster, cluster = -1 AS DBSCAN_Noise_Flag,
       CAST(max(cluster) OVER () + 1 AS BIGINT) AS n_clusters, count(*) FILTER (cluster = -1) OVER () AS n_noise,
       round(count(*) FILTER (cluster = -1) OVER () / count(*) OVER (), 6) AS noise_ratio FROM res""")


def _draw(x: str, first: str, second: str) -> str:
    h = f"((((({x}) & {LOW}) + {first}) & {LOW}) * {FIRST} & {WORD})"
    g = f"(((xor({h}, {h} >> 16) + {second} + (({x}) >> 30)) & {LOW}) * {SECOND} & {WORD})"
    return f"xor({g}, {g} >> 15)"


def _keys(name: str, purpose: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT tree, CAST('0x' || substr(d, 1, 7) AS BIGINT) AS a, CAST('0x' || substr(d, 8, 7) AS BIGINT) AS c "
            f"FROM (SELECT tree, md5('{SEED}:{purpose}:' || tree) AS d FROM range({TREES}) t(tree)))")


def _forest() -> str:
    """CTEs over ``sc``/``lx`` (id, f, v): ``split`` (tree, node, f, thr) and ``leaf`` (tree, node, value)."""
    parts = [
        _keys("ks", "sample"), _keys("kf", "feature"), _keys("kt", "threshold"),
        f"sm AS MATERIALIZED (SELECT tree, id FROM (SELECT tree, id, row_number() OVER (PARTITION BY tree ORDER BY {_draw('b', 'a', 'c')}, id) AS r "
        f"FROM (SELECT id, CAST('0x' || substr(md5(id), 1, 15) AS BIGINT) AS b FROM sc), ks) WHERE r <= {PSI})",
        "lv0 AS MATERIALIZED (SELECT tree, id, CAST(1 AS BIGINT) AS node FROM sm)",
    ]
    for d in range(DEPTH):
        parts += [
            f"mm{d} AS (SELECT tree, node, f, min(v) AS lo, max(v) AS hi FROM lv{d} JOIN lx USING (id) GROUP BY ALL),"
            f"\ncd{d} AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY f) - 1 AS r, count(*) OVER (PARTITION BY tree, node) AS m FROM mm{d} WHERE hi > lo),"
            f"\npk{d} AS (SELECT cd{d}.*, lo + {_draw('node', 'kt.a', 'kt.c')} / 4294967296.0::DOUBLE * (hi - lo) AS t FROM cd{d} JOIN kf USING (tree) JOIN kt USING (tree) "
            f"WHERE r = {_draw('node', 'kf.a', 'kf.c')} % m),"
            f"\nsp{d} AS MATERIALIZED (SELECT tree, node, f, CASE WHEN t >= hi THEN lo ELSE t END AS thr FROM pk{d})",
            f"lv{d + 1} AS MATERIALIZED (SELECT lv{d}.tree, lv{d}.id, 2 * lv{d}.node + CASE WHEN v <= thr THEN 0 ELSE 1 END AS node "
            f"FROM lv{d} JOIN sp{d} ON sp{d}.tree = lv{d}.tree AND sp{d}.node = lv{d}.node JOIN lx ON lx.id = lv{d}.id AND lx.f = sp{d}.f)",
        ]
    levels = " UNION ALL ".join(f"SELECT tree, node, {d} AS depth FROM lv{d}" for d in range(DEPTH + 1))
    parts += [
        "split AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM sp{d}" for d in range(DEPTH)) + ")",
        f"sized AS (SELECT tree, node, depth, count(*) AS n FROM ({levels}) GROUP BY ALL)",
        "leaf AS MATERIALIZED (SELECT tree, node, depth + CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 "
        "ELSE 2 * (ln(n - 1) + 0.5772156649015329::DOUBLE) - 2 * (n - 1)::DOUBLE / n END AS value FROM sized ANTI JOIN split USING (tree, node))",
    ]
    return ",\n".join(parts)


def _scores(rows: str, values: str, out: str) -> str:
    """CTEs that walk the ids of ``rows`` (with the values of the long table ``values``) to ``out`` (id, raw)."""
    parts = [f"{out}w0 AS (SELECT id, tree, CAST(1 AS BIGINT) AS node FROM {rows}, range({TREES}) t(tree))"]
    for d in range(DEPTH):
        parts.append(
            f"{out}w{d + 1} AS MATERIALIZED (SELECT w.id, w.tree, CASE WHEN s.f IS NULL THEN w.node WHEN x.v <= s.thr THEN 2 * w.node ELSE 2 * w.node + 1 END AS node "
            f"FROM {out}w{d} w LEFT JOIN split s ON s.tree = w.tree AND s.node = w.node LEFT JOIN {values} x ON x.id = w.id AND x.f = s.f)")
    c = f"(2 * (ln({PSI - 1}) + 0.5772156649015329::DOUBLE) - 2 * {PSI - 1}::DOUBLE / {PSI})"
    parts.append(f"{out} AS MATERIALIZED (SELECT w.id, pow(2.0::DOUBLE, -(sum(value) / {TREES}) / {c}) - 0.5 AS raw FROM {out}w{DEPTH} w JOIN leaf USING (tree, node) GROUP BY w.id)")
    return ",\n".join(parts)


def _base() -> str:
    cte, _ = _feature_sql()
    return f"{cte},\n{_scaled()},\n{_long('sc', 'lx')},\n{_forest()},\n{_scores('sc', 'lx', 'own')}"


FLAGS = """SELECT id AS Precinct_ID, raw > 0 AS IF_Anomaly_Flag,
       round(least(greatest((raw - (SELECT min(raw) FROM own)) / ((SELECT max(raw) FROM own) - (SELECT min(raw) FROM own)), 0.0), 1.0), 6) AS IF_Anomaly_Score"""


def isolation_forest() -> str:
    return with_views(f"WITH {_base()}\n{FLAGS} FROM own")


def score_new_data() -> str:
    typed, _ = _feature_sql()
    typed = typed.replace("fb AS", "tfb AS").replace("ft AS", "tft AS").replace("FROM fb b", "FROM tfb b").replace("FROM returns", "FROM returns_typed")
    typed = typed.replace(f"SELECT {PID} AS Precinct_ID", f"SELECT {PID} || '::' || Vote_Type AS Precinct_ID", 1)
    return with_views(f"""WITH returns_typed AS ({returns_sql(True)}),
{_base()},
{typed},
{_scaled('tft', 'tsc')},
{_long('tsc', 'tlx')},
{_scores('tsc', 'tlx', 'fresh')}
{FLAGS} FROM fresh""")


def if_importance() -> str:
    """Each feature from the row that the keyed permutation of its number names; one walk per row and feature."""
    _, names = _feature_sql()
    rows = f"SELECT f.p, idx AS i, idx AS x FROM nx, range({len(names)}) f(p)"
    for r in range(16):
        paired = f"SELECT a.p, a.i, a.x, k.c, (k.k - a.x + k.n) % k.n AS o FROM ({rows}) a JOIN ky k ON k.p = a.p AND k.r = {r}"
        first = f"SELECT p, i, x, o, ((greatest(x, o) + c) & {LOW}) * {FIRST} & {WORD} AS h FROM ({paired})"
        second = f"SELECT p, i, x, o, (xor(h, h >> 16) & {LOW}) * {SECOND} & {WORD} AS h FROM ({first})"
        rows = f"SELECT p, i, CASE WHEN (h >> 17) & 1 = 1 THEN o ELSE x END AS x FROM ({second})"
    return with_views(f"""WITH {_base()},
used AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS p FROM (SELECT f FROM lx GROUP BY f HAVING min(v) <> max(v))),
nx AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM sc),
kd AS (SELECT p, r, md5('{SEED}:' || p || ':' || r) AS d FROM range({len(names)}) a(p), range(16) b(r)),
ky AS MATERIALIZED (SELECT p, r, n, CAST('0x' || substr(d, 1, 15) AS BIGINT) % n AS k, CAST('0x' || substr(d, 16, 7) AS BIGINT) AS c FROM kd, (SELECT max(n) AS n FROM nx)),
im AS MATERIALIZED ({rows}),
sw AS MATERIALIZED (SELECT used.f AS j, a.id AS row_id, a.id || '#' || used.f AS id, b.id AS other FROM im JOIN used ON used.p = im.p JOIN nx a ON a.idx = im.i JOIN nx b ON b.idx = im.x),
vx AS MATERIALIZED (SELECT sw.id, lx.f, lx.v FROM sw JOIN lx ON lx.id = CASE WHEN lx.f = sw.j THEN sw.other ELSE sw.row_id END),
{_scores('sw', 'vx', 'changed')}
SELECT list_extract({names!r}, CAST(sw.j + 1 AS BIGINT)) AS feature, round(avg(abs(changed.raw - own.raw)), 6) AS importance
FROM changed JOIN sw ON sw.id = changed.id JOIN own ON own.id = sw.row_id GROUP BY sw.j""")


def forest_round_trip() -> str:
    return isolation_forest()


def method_status(eps: float = 1.5, least: int = 5) -> str:
    """Every method of the workflow, judged by what it needs of the data."""
    cte, names = _feature_sql()
    share = "CASE WHEN Valid_Contest_Votes > 0 THEN Votes_Candidate_A / Valid_Contest_Votes END"
    turnout = "CASE WHEN Registered_Voters > 0 THEN Ballots_Cast / Registered_Voters * 100 END"
    total = " + ".join(f"(p.{n} - q.{n}) * (p.{n} - q.{n})" for n in names)
    checks = {
        "turnout_share": f"(SELECT count(*) >= 20 AND count(DISTINCT t) > 1 FROM (SELECT {turnout} AS t, {share} AS s FROM returns) WHERE t BETWEEN 0 AND 100 AND s BETWEEN 0 AND 1)",
        "vote_share_by_count": f"(SELECT count(*) >= 3 AND count(DISTINCT Votes_Candidate_A) >= 2 FROM returns WHERE {share} IS NOT NULL)",
        "down_ballot_difference": "(SELECT count(*) > 0 FROM returns WHERE Votes_Candidate_A > 0 AND Votes_Down_Ballot_A >= 0)",
        "digit_diagnostics": "(SELECT greatest(count(Votes_Candidate_A), count(Votes_Candidate_B), count(Votes_Candidate_C)) >= 30 FROM returns)",
        "spatial": f"(SELECT count(*) >= 3 AND var_pop(s) > 0 FROM (SELECT {share} AS s FROM returns WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL) WHERE s IS NOT NULL)",
        "isolation_forest": "(SELECT " + " OR ".join(f"coalesce(min({n}) <> max({n}), false)" for n in names) + " FROM ft)",
        "dbscan": f"(SELECT count(*) > 0 FROM (SELECT p.id FROM sc p JOIN sc q ON sqrt({total}) <= {eps} GROUP BY p.id HAVING count(*) >= {least}))",
    }
    rows = " UNION ALL ".join(f"SELECT '{m}' AS method, {check} AS ok" for m, check in checks.items())
    return with_views(f"WITH {cte},\n{_scaled()}\nSELECT method, CASE WHEN ok THEN 'successful' ELSE 'unavailable' END AS state, CASE WHEN ok THEN 'done' END AS message FROM ({rows})")
