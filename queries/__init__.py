"""Registered queries: each couples a Spark query with its DuckDB SQL."""
