"""DataFrame operators: guards, joins, aggregates, models and inference."""
