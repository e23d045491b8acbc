"""Structured Streaming: routing, recent views, audit append, lockout state, windowed counts."""
