from lexiweight.sinks.files import write_documents
from lexiweight.sinks.text import (
    report_lines,
    stage_lines,
    write_sorted_report,
    write_stage,
    write_table,
)

__all__ = ["report_lines", "stage_lines", "write_documents", "write_sorted_report", "write_stage", "write_table"]
