"""Reserved for Structured Streaming; the engine's own operators are batch operators."""
