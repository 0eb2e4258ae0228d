"""Queries over the driver tables, each with the same result as DuckDB SQL where SQL can say it."""
