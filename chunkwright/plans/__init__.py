"""Query catalogue and the fixtures that it runs on."""
