"""Clinical data-quality and triage analytics as Spark DataFrame operators."""
