"""The same stages on streams of pages and events."""
