"""Structured Streaming: latency windows and admission queues over files as they arrive."""
