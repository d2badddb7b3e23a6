"""Operators of a large-scale training-data pipeline over the documents, pages
and conversations tables. Nothing outside this subpackage imports it but the
guarded registration in ``__spark_entry__.py``."""
