"""Ledger of AI-assisted coding work on Spark: sources, operators, functions, plans and streams."""
