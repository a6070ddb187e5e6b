"""Structured Streaming: stateful strokes, upsert sinks, replay."""
