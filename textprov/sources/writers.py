"""Writers of predictions, submissions and generation records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textprov.operators.rows import to_submission

# Everything quoted, nulls marked, blanks kept: what is read back is what was written.
CSV_WRITE = dict(
    header=True,
    quoteAll=True,
    quote='"',
    escape='"',
    nullValue="\\N",
    emptyValue="",
    ignoreLeadingWhiteSpace=False,
    ignoreTrailingWhiteSpace=False,
)
# A multi-line CSV file is read by one task, so no file may grow with the table.
ROWS_PER_FILE = 1_000_000


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.options(**CSV_WRITE, maxRecordsPerFile=ROWS_PER_FILE).mode(mode).csv(path)


def write_predictions(results: DataFrame, out_dir: str, run: str, tag: str = "last") -> dict[str, str]:
    """Write ``id, predictions, truths`` and the submission ``id, generated`` of a run.

    ``tag`` is ``best`` or ``last``; a later evaluation of the run replaces it.
    """
    base = f"{out_dir.rstrip('/')}/{run}"
    paths = {"results": f"{base}/result_df_{tag}", "submission": f"{base}/oof_df_{tag}"}
    write_csv(results.select("id", "predictions", "truths"), paths["results"], "overwrite")
    write_csv(to_submission(results), paths["submission"], "overwrite")
    return paths


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Generation records as JSON lines in part files."""
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).mode(mode).json(path)
