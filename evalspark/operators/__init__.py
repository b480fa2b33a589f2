"""Relational operators over the engine's tables (samples, verdicts, metrics)."""
