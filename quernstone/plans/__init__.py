"""Session helpers and the queries over the standard tables."""
