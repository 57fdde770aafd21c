"""Palimpsest: document-layout, text-quality and corpus analytics on PySpark."""
