"""docket: document and case analytics as set-oriented PySpark jobs."""
