"""Whole runs: readings to grid, grid to workbook, sidecar and JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldledger.operators import assembly, review
from fieldledger.operators.correction import PLAIN, Rules, correct_page
from fieldledger.session import materialize
from fieldledger.sources.sinks import write_sidecar, write_workbook


@dataclass
class Run:
    """corrected: every line; kept: those with an output, with groups; rows: the output; the rest tells of the run."""

    corrected: DataFrame
    kept: DataFrame
    rows: DataFrame
    skipped: DataFrame
    findings: DataFrame
    summary: DataFrame
    expected: DataFrame | None = None
    known_gaps: DataFrame | None = None

    def grid(self) -> DataFrame:
        """batch_id, grid: a batch's rows, audit, skipped lines and summary as JSON."""
        return review.grid_json(self.kept, self.skipped, self.rows, self.corrected, self.expected, self.known_gaps)


def process(lines: DataFrame, expected: DataFrame | None = None, known_gaps: DataFrame | None = None, rules: Rules = PLAIN) -> Run:
    """lines: batch_id, page_no, row_index, survey_raw, meter_raw, remarks_raw, and survey_conf, meter_conf, remarks_conf if known.

    expected: batch_id, page_no, detected_rules; known_gaps: previous, current of gaps that are no findings.
    """
    corrected = materialize(correct_page(lines, rules), "corrected")
    kept, skipped = assembly.grouped(corrected)
    kept, skipped = materialize(kept, "kept"), materialize(skipped, "skipped")
    rows = assembly.output_rows(kept)
    findings = assembly.audit_all(rows, corrected, expected, known_gaps)
    return Run(corrected, kept, rows, skipped, findings, assembly.summary(rows, skipped), expected, known_gaps)


def export(lines: DataFrame, path: str, sidecar: str | None = None, **options) -> Run:
    """Runs process() and writes the workbook of a single batch, and the review sidecar where it is asked for."""
    done = process(lines, **options)
    write_workbook(done.rows, path)
    if sidecar:
        write_sidecar(done.corrected, done.rows, done.skipped, done.findings, sidecar)
    return done
