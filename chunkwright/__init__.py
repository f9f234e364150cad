"""A Spark engine for content-addressed data: chunks, snapshots, verification, restore and their statistics."""
