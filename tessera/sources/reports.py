"""Reports of an audit as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Where a report goes unless it is told otherwise; a report has at most this many findings (a row a code).
DEFAULT_NAME, MOST = "mapping-audit.json", 10_000
FINDING = "code STRING, severity STRING, n BIGINT, ok BOOLEAN"


def report_path(arguments: list[str], folder: str) -> tuple[list[str], str | None]:
    """(other arguments, path to write to) of a command's arguments: ``--write`` alone asks for the default name in ``folder``,
    ``--write PATH`` and ``--write=PATH`` for a path, relative ones below ``folder``; without it there is no path."""
    rest, path, left = [], None, list(arguments)

    def below(value: str) -> str:
        return value if value.startswith("/") or "://" in value else f"{folder}/{value}"

    while left:
        a = left.pop(0)
        if a == "--write":
            path = below(left.pop(0)) if left and left[0] and not left[0].startswith("-") else f"{folder}/{DEFAULT_NAME}"
        elif a.startswith("--write="):
            if not (value := a.removeprefix("--write=").strip()):
                raise ValueError("--write= needs a path")
            path = below(value)
        else:
            rest.append(a)
    return rest, path


def summary(found: DataFrame) -> dict:
    """{ok, errors, warnings, findings} of findings (code, severity, n, ok), a row a code: failing ones first, then by code."""
    rows = found.select("code", "severity", "n", "ok").orderBy("ok", "code", "severity").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} findings: group them by code first")
    failing = [r["severity"] for r in rows if not r["ok"]]
    return {"ok": "error" not in failing, "errors": failing.count("error"), "warnings": failing.count("warning"), "findings": [r.asDict() for r in rows]}


def save_findings(found: DataFrame, path: str) -> dict:
    """Write the report, whole or not at all; returns it."""
    report = summary(found)
    shared.save_json(found.sparkSession, path, report)
    return report


def findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a saved report."""
    return spark.read.schema(f"findings ARRAY<STRUCT<{FINDING.replace(' ', ': ').replace(',:', ',')}>>").json(path, multiLine=True).select(F.inline("findings"))
