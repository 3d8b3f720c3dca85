"""Spark operators over grids of coded cells, dictionaries, recognition jobs and evaluation sets."""
