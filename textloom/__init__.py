"""Rule-driven text, link and document rewriting on Spark."""
