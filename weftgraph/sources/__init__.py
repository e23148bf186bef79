"""Readers: source trees, routing by language, fact extraction, snapshots."""
