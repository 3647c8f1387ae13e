"""Relational operators: features, drift, metrics, risk, registry, PII spans, records, tensors, models."""
