from lexiweight.sources.files import directory_size, scan_documents, scan_lines
from lexiweight.sources.listing import list_files
from lexiweight.sources.stages import STAGES, scan_report, scan_stage, scan_table
from lexiweight.sources.tables import from_table, union_corpora

__all__ = [
    "STAGES",
    "directory_size",
    "from_table",
    "list_files",
    "scan_documents",
    "scan_lines",
    "scan_report",
    "scan_stage",
    "scan_table",
    "union_corpora",
]
