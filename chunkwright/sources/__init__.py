"""Sources and sinks: directory scan, content store, index files and restore."""
