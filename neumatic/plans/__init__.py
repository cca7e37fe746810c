"""The derived score corpus and the queries over it."""
