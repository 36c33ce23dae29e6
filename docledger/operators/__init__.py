"""Operators over documents, invoices and jobs."""
