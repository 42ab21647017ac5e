"""SQL text of expressions for parsing and checking counts (all JVM-side)."""

from __future__ import annotations

# Text tokens read as missing (the CSV reader's default NA list).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Plain decimal/scientific numbers only: rejects '1d', '1f', 'inf', hex and the like.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

ISCLOSE_RTOL = 1e-5
ISCLOSE_ATOL = 1e-8


# ---- SQL-text forms (one JVM call per expression instead of one per operator)

def q(name: str) -> str:
    """Backtick-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def lit_str(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NA_SQL = "(" + ", ".join(lit_str(t) for t in NA_TOKENS) + ")"
_NUM_SQL = lit_str(NUMBER_PATTERN)


def sql_na(c: str) -> str:
    return f"(CASE WHEN {c} IN {_NA_SQL} THEN NULL ELSE {c} END)"


def sql_parse_number(c: str, dtype: str) -> str:
    if dtype == "string":
        s = sql_na(c)
        return f"(CASE WHEN {s} RLIKE {_NUM_SQL} THEN try_cast(trim({s}) AS DOUBLE) END)"
    v = f"try_cast({c} AS DOUBLE)"
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def sql_present(c: str, dtype: str) -> str:
    if dtype == "string":
        return f"({sql_na(c)} IS NOT NULL)"
    if dtype in ("double", "float"):
        return f"({c} IS NOT NULL AND NOT isnan({c}))"
    return f"({c} IS NOT NULL)"


def sql_not_integral(x: str) -> str:
    return f"(abs({x} - rint({x})) > {ISCLOSE_ATOL!r} + {ISCLOSE_RTOL!r} * abs(rint({x})))"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, {lit_str(r'^\s+|\s+$')}, '')"
