"""Market views and the registry of runnable queries."""
