"""Structured Streaming operators: early stop over token streams, partial logs."""
