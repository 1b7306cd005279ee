"""Millrace: a Spark-first analytics engine (fail-closed SQL, joins, sketches, standing queries, analysis)."""
