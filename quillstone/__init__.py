"""Catalog, text and corpus analytics on PySpark: lazy DataFrame operators, each paired with a checkable SQL form."""
