"""Registered queries: each module's QUERIES maps a name to (function of (spark, folder), DuckDB SQL or None)."""
