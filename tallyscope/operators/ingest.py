"""Canonicalisation and row validation (P1-P13, V3-V20) as one projection pass.

Every row rule is a column expression that yields an issue struct or NULL; the
array of issues rides along with the row (``_issues``). Accepted/excluded split,
the long issues table and the counts all derive from that one validated frame,
so the data is read and checked once. The only shuffle is the duplicate-key
count (V7): ``groupBy(Precinct_ID).count()`` is combined map-side (a hot key
collapses before the shuffle) and joined back - broadcast when the duplicate
table is small enough after counting it, otherwise a shuffle join that AQE's
skew handling can split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_dimension
from ..functions.numeric import lit_str, q, sql_na, sql_not_integral, sql_parse_number, sql_present, sql_trim
from ..schema import (
    ALTERNATE_SIGNATURE, BALLOTS_OVER_REGISTRATION, CANONICAL, CANONICAL_COUNTS, CONTEST_OVER_BALLOTS, ContestSchema, Settings,
    alternate_schema, default_schema,
)

ISSUE_TYPE = "struct<code:string,severity:string,column:string,message:string>"
ROW = "_row"


class DataValidationError(ValueError):
    """The table cannot be interpreted under the selected schema (file-level, fatal)."""

    def __init__(self, message: str, issues: list[dict] | None = None):
        super().__init__(message)
        self.issues = issues or []


@dataclass
class Ingestion:
    """Validated returns. ``validated`` holds every row with its ``_issues``."""

    validated: DataFrame
    schema: ContestSchema
    file_issues: list[dict] = field(default_factory=list)
    source_columns: list[str] = field(default_factory=list)
    provenance: DataFrame | None = None  # one row per source file, where the rows came from files

    @property
    def _errors(self) -> Column:
        return F.filter(F.col("_issues"), lambda x: x["severity"] == "error")

    @property
    def accepted(self) -> DataFrame:
        return self.validated.filter(F.size(self._errors) == 0).drop("_issues")

    @property
    def excluded(self) -> DataFrame:
        reasons = F.array_join(F.array_sort(F.array_distinct(F.transform(self._errors, lambda x: x["code"]))), ";")
        return (
            self.validated.filter(F.size(self._errors) > 0)
            .withColumn("Exclusion_Reasons", reasons)
            .drop("_issues")
        )

    @property
    def issues(self) -> DataFrame:
        """Long issues table: one row per (row, rule, column)."""
        rows = self.validated.select(
            F.col(ROW).alias("row"), "Precinct_ID", F.explode("_issues").alias("i")
        ).select("row", "Precinct_ID", "i.code", "i.severity", "i.column", "i.message")
        if not self.file_issues or self.validated.isStreaming:
            # File-level issues stay in ``file_issues`` for a stream (a stream
            # cannot be unioned with a batch table).
            return rows
        spark = self.validated.sparkSession
        extra = spark.createDataFrame(
            [(None, None, d["code"], d["severity"], d.get("column"), d["message"]) for d in self.file_issues],
            "row bigint, Precinct_ID string, code string, severity string, column string, message string",
        )
        return rows.unionByName(extra)

    def report(self) -> dict:
        """Row counts and issue counts in one aggregation."""
        errs = self._errors
        row = self.validated.agg(
            F.count(F.lit(1)).alias("original_rows"),
            F.count_if(F.size(errs) > 0).alias("excluded_rows"),
            F.coalesce(F.sum(F.size(errs)), F.lit(0)).alias("errors"),
            F.coalesce(F.sum(F.size("_issues") - F.size(errs)), F.lit(0)).alias("warnings"),
        ).first()
        file_errors = sum(1 for d in self.file_issues if d["severity"] == "error")
        file_warnings = len(self.file_issues) - file_errors
        out = {
            "original_rows": int(row["original_rows"]),
            "excluded_rows": int(row["excluded_rows"]),
            "errors": int(row["errors"]) + file_errors,
            "warnings": int(row["warnings"]) + file_warnings,
        }
        out["accepted_rows"] = out["original_rows"] - out["excluded_rows"]
        out["is_valid"] = out["errors"] == 0
        return out


# ------------------------------------------------------------------ schema


def select_schema(columns: list[str], schema: ContestSchema | None = None) -> ContestSchema:
    """Explicit > configured (if its required columns exist) > alternate > configured."""
    if schema is not None:
        return schema
    configured = default_schema()
    present = set(columns)
    required = {configured.column("jurisdiction"), configured.column("precinct"), *configured.candidate_columns}
    if configured.column("valid_contest_votes"):
        required.add(configured.column("valid_contest_votes"))
    if configured.column("valid_contest_votes") and required <= present:
        return configured
    if ALTERNATE_SIGNATURE <= present:
        return alternate_schema()
    return configured


def check_mapping(columns: list[str], schema: ContestSchema) -> None:
    """V3/V4: a contest-total mapping is required and mapped columns must exist."""
    if not schema.column("valid_contest_votes"):
        msg = "No column is mapped to valid_contest_votes"
        raise DataValidationError(msg, [_file_issue("missing_contest_total_mapping", "error", None, msg)])
    required = [schema.column("jurisdiction"), schema.column("precinct"), *schema.candidate_columns, schema.column("valid_contest_votes")]
    missing = sorted({c for c in required if c not in columns})
    if missing:
        msg = f"The table lacks mapped columns: {', '.join(missing)}"
        raise DataValidationError(msg, [_file_issue("unsupported_column_mapping", "error", None, msg)])


def _file_issue(code: str, severity: str, column: str | None, message: str) -> dict:
    return {"code": code, "severity": severity, "column": column, "message": message}


def _issue(cond: str, code: str, severity: str, column: str | None, message: str) -> str:
    """SQL text: an issue struct when ``cond`` holds, else NULL."""
    col = "CAST(NULL AS STRING)" if column is None else lit_str(column)
    return (
        f"CASE WHEN coalesce({cond}, false) THEN named_struct('code', {lit_str(code)}, "
        f"'severity', {lit_str(severity)}, 'column', {col}, 'message', {lit_str(message)}) END"
    )


class _Frame:
    """Driver-side bookkeeping of column names (Spark resolves names case-insensitively)."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.file_issues: list[dict] = []
        self.stages: list[str] = []

    def flush(self, issues: list[str]) -> None:
        """Evaluate pending issue expressions against the current column values."""
        if issues:
            name = f"_iss{len(self.stages)}"
            self.df = self.df.withColumn(name, F.expr("array(" + ", ".join(issues) + ")"))
            self.stages.append(name)
            issues.clear()

    def has(self, name: str) -> bool:
        low = name.lower()
        return any(c.lower() == low for c in self.df.columns)

    def dtype(self, name: str) -> str:
        low = name.lower()
        for c, t in self.df.dtypes:
            if c.lower() == low:
                return t
        raise KeyError(name)

    def preserve(self, name: str) -> None:
        """Copy a source column away before a reserved column overwrites it."""
        if not self.has(name):
            return
        kept = f"Source_Original__{name}"
        n = 2
        while self.has(kept):
            kept = f"Source_Original__{name}__{n}"
            n += 1
        self.df = self.df.withColumn(kept, F.col(q(name)))
        self.file_issues.append(
            _file_issue(
                "reserved_column_collision",
                "warning",
                name,
                f"{name} is generated here; the source column of that name is kept as {kept}",
            )
        )


# ------------------------------------------------------------------ validate


def ingest(
    df: DataFrame,
    schema: ContestSchema | None = None,
    settings: Settings | None = None,
    row_key: str | None = None,
    streaming: bool = False,
) -> Ingestion:
    """Canonicalise and validate a returns table.

    The returned frame is lazy; the call itself looks for a first row and counts repeated keys.

    ``streaming=True`` skips the checks that need the whole table (emptiness and
    the duplicate-key rule V7) so the plan runs on a streaming DataFrame.
    """
    settings = settings or Settings()
    source_columns = list(df.columns)
    schema = select_schema(source_columns, schema)
    check_mapping(source_columns, schema)
    if not streaming and df.isEmpty():
        raise DataValidationError("The table has no rows", [_file_issue("empty_dataset", "error", None, "no rows")])

    if row_key is None and streaming:
        df = df.withColumn(ROW, F.lit(None).cast("bigint"))
    elif row_key is None:
        # Captured at load, before any shuffle, so it names the source position.
        df = df.withColumn(ROW, F.monotonically_increasing_id())
    else:
        df = df.withColumn(ROW, F.col(row_key).cast("bigint"))
    fr = _Frame(df)

    # P3 canonical copies (source columns are kept).
    for concept, canonical in CANONICAL.items():
        source = schema.column(concept)
        if source and fr.has(source):
            if source.lower() != canonical.lower() and fr.has(canonical):
                fr.preserve(canonical)
            if source != canonical:
                fr.df = fr.df.withColumn(canonical, F.col(f"`{source}`"))

    # P5 derived registration for the alternate layout.
    if schema.registration_parts:
        parts = [sql_parse_number(q(c), fr.dtype(c)) for c in schema.registration_parts]
        fr.preserve("Registered_Voters")
        fr.df = fr.df.withColumn("Registered_Voters", F.expr(" + ".join(parts)))
        fr.file_issues.append(_file_issue(
            "legacy_registration_derived", "warning", "Registered_Voters",
            f"Registration is the sum of {', '.join(schema.registration_parts)}; NULL where one of them is no number",
        ))

    issues: list[str] = []

    # P6 / V6 identifiers.
    ident = ["Jurisdiction", "Precinct"] + (["Vote_Type"] if fr.has("Vote_Type") else [])
    trimmed = {}
    for c in ident:
        value = f"CAST({q(c)} AS STRING)"
        if fr.dtype(c) == "string":
            value = sql_na(value)
        trimmed[c] = sql_trim(value)
        issues.append(_issue(f"({trimmed[c]} IS NULL OR {trimmed[c]} = '')", "missing_identifier", "error", c, f"{c} is blank"))
    fr.flush(issues)
    fr.df = fr.df.withColumns({c: F.expr(e) for c, e in trimmed.items()})
    fr.preserve("Precinct_ID")
    pid = "concat_ws('::', " + ", ".join(f"coalesce({q(c)}, '')" for c in ident) + ")"
    fr.df = fr.df.withColumn("Precinct_ID", F.expr(pid))

    # P8 / V8-V10 counts.
    count_cols = [*schema.candidate_columns, *schema.registration_parts, *(p.column for p in schema.pairs)]
    count_cols += [c for c in CANONICAL_COUNTS if fr.has(c)]
    # Each number is parsed once, into a column of its own that the rules read.
    parsed = {f"_n_{c}": (c, fr.dtype(c)) for c in dict.fromkeys(count_cols) if fr.has(c)}
    fr.df = fr.df.withColumns({n: F.expr(sql_parse_number(q(c), t)) for n, (c, t) in parsed.items()})
    for n, (c, t) in parsed.items():
        issues.append(_issue(f"({sql_present(q(c), t)} AND {q(n)} IS NULL)", "nonnumeric_count", "error", c, f"{c} is no number"))
        issues.append(_issue(f"({q(n)} IS NOT NULL AND {sql_not_integral(q(n))})", "nonintegral_count", "error", c, f"{c} is no whole number"))
        issues.append(_issue(f"({q(n)} < 0)", "negative_count", "error", c, f"{c} is below 0"))
    fr.flush(issues)
    fr.df = fr.df.withColumns({c: F.col(n) for n, (c, _) in parsed.items()}).drop(*parsed)

    # P9 / V15 coordinates; P10 / V16-V17 reported turnout.
    places = {c: span for c, span in (("Latitude", (-90, 90)), ("Longitude", (-180, 180))) if fr.has(c)}
    turnout = ["Reported_Turnout_Percent"] if fr.has("Reported_Turnout_Percent") else []
    fr.df = fr.df.withColumns({f"_n_{c}": F.expr(sql_parse_number(q(c), fr.dtype(c))) for c in [*places, *turnout]})
    values = {}
    for c, (lo, hi) in places.items():
        n = q(f"_n_{c}")
        bad = f"({n} IS NULL OR NOT ({n} BETWEEN {lo} AND {hi}))"
        issues.append(_issue(bad, "invalid_or_missing_coordinate", "warning", c, f"no {c} between {lo} and {hi}"))
        values[c] = f"CASE WHEN NOT {bad} THEN {n} END"
    for c in turnout:
        n, t = q(f"_n_{c}"), fr.dtype(c)
        issues.append(_issue(f"({sql_present(q(c), t)} AND {n} IS NULL)", "nonnumeric_reported_turnout", "error", c, "the reported turnout is no number"))
        issues.append(_issue(f"({n} IS NOT NULL AND NOT ({n} BETWEEN 0 AND 100))", "impossible_reported_turnout", "error", c, "the reported turnout is no percentage"))
        values[c] = n
    fr.flush(issues)
    fr.df = fr.df.withColumns({c: F.expr(e) for c, e in values.items()}).drop(*[f"_n_{c}" for c in values])

    # V11-V14 row rules.
    valid = q("Valid_Contest_Votes")
    critical = ["Valid_Contest_Votes", *schema.candidate_columns] + (["Ballots_Cast"] if fr.has("Ballots_Cast") else [])
    for c in critical:
        issues.append(_issue(f"({q(c)} IS NULL)", "missing_critical_count", "error", c, f"{c} is needed and not there"))
    any_cand = " OR ".join(f"{q(c)} IS NOT NULL" for c in schema.candidate_columns)
    cand_sum = "(" + " + ".join(f"coalesce({q(c)}, 0D)" for c in schema.candidate_columns) + ")"
    total = f"CASE WHEN {any_cand} THEN {cand_sum} END"
    if schema.column("write_in_votes") and fr.has("Write_In_Votes"):
        total = f"({total} + coalesce(`Write_In_Votes`, 0D))"
    issues.append(_issue(f"({total} > {valid})", "candidate_votes_exceed_contest", "error", None, "candidates and write-ins add up to more than Valid_Contest_Votes"))
    if fr.has("Ballots_Cast") and CONTEST_OVER_BALLOTS not in schema.exempt:
        issues.append(_issue(f"({valid} > `Ballots_Cast`)", "contest_votes_exceed_ballots", "error", None, "more Valid_Contest_Votes than Ballots_Cast"))
    if fr.has("Ballots_Cast") and fr.has("Registered_Voters") and BALLOTS_OVER_REGISTRATION not in schema.exempt:
        issues.append(_issue("(`Ballots_Cast` > `Registered_Voters`)", "ballots_exceed_registration", "error", None, "more Ballots_Cast than Registered_Voters"))
    fr.flush(issues)

    # P11-P13 derived columns and V18.
    derived = {}
    for cd in schema.candidates:
        fr.preserve(cd.share_column)
        derived[cd.share_column] = f"CASE WHEN {valid} > 0 THEN {q(cd.column)} / {valid} END"
    if fr.has("Ballots_Cast") and fr.has("Registered_Voters"):
        calc = "CASE WHEN `Registered_Voters` > 0 THEN `Ballots_Cast` / `Registered_Voters` * 100 END"
        fr.preserve("Calculated_Turnout_Percent")
        derived["Calculated_Turnout_Percent"] = calc
        if fr.has("Reported_Turnout_Percent"):
            fr.preserve("Turnout_Discrepancy_Percentage_Points")
            diff = f"abs(`Reported_Turnout_Percent` - ({calc}))"
            derived["Turnout_Discrepancy_Percentage_Points"] = diff
            tol = settings.turnout_tolerance
            issues.append(_issue(f"({diff} > {float(tol)!r})", "turnout_mismatch", "warning", None, f"reported turnout is over {tol:g} points off ballots / registration"))
    fr.flush(issues)
    fr.df = fr.df.withColumns({c: F.expr(e) for c, e in derived.items()})

    if streaming:
        fr.file_issues.append(_file_issue("duplicate_check_deferred", "warning", None,
                                          "repeated Precinct_IDs (V7) are looked for in the batch table only"))
        all_issues = F.expr("filter(concat(" + ", ".join(q(c) for c in fr.stages) + "), x -> x IS NOT NULL)")
        validated = fr.df.withColumn("_issues", all_issues).drop(*fr.stages)
        return Ingestion(validated=validated, schema=schema, file_issues=fr.file_issues, source_columns=source_columns)

    # V7 duplicates over every row, including otherwise invalid ones.
    dup_keys = fr.df.groupBy("Precinct_ID").count().filter(F.col("count") > 1).select("Precinct_ID", F.lit(True).alias("_dup"))
    with_dup = join_dimension(fr.df, dup_keys, "Precinct_ID", "left")
    dup = _issue("`_dup`", "duplicate_precinct_id", "error", None, "this Precinct_ID stands in several rows")
    all_issues = F.expr("filter(concat(" + ", ".join(q(c) for c in fr.stages) + f", array({dup})), x -> x IS NOT NULL)")
    validated = with_dup.withColumn("_issues", all_issues).drop("_dup", *fr.stages)
    return Ingestion(validated=validated, schema=schema, file_issues=fr.file_issues, source_columns=source_columns)


def canonical_columns(ing: Ingestion) -> list[str]:
    """Canonical + derived columns present after ingestion (source-only columns excluded)."""
    cols = ["Precinct_ID", "Jurisdiction", "Precinct"]
    names = set(ing.validated.columns)
    if "Vote_Type" in names:
        cols.append("Vote_Type")
    for c in (*CANONICAL_COUNTS, *ing.schema.candidate_columns, *ing.schema.registration_parts,
              *(p.column for p in ing.schema.pairs),
              "Latitude", "Longitude", "Reported_Turnout_Percent", *ing.schema.share_columns,
              "Calculated_Turnout_Percent", "Turnout_Discrepancy_Percentage_Points"):
        if c in names and c not in cols:
            cols.append(c)
    return cols
