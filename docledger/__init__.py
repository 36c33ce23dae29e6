"""Invoice document analytics as Spark DataFrame jobs."""

from docledger.plans.pipeline import (
    invoice_headers,
    invoice_lines,
    parse_documents,
    process_events,
    with_xml,
)

__all__ = ["invoice_headers", "invoice_lines", "parse_documents", "process_events", "with_xml"]
