"""Document data work on Spark: detection, redaction, templates, invoices."""
