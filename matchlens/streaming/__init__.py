"""Live game, odds and connectivity state with Structured Streaming."""
