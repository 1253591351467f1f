"""Column expressions: nothing in here touches data or needs a session."""
