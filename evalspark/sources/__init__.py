"""Sources (file readers with declared schemas) and sinks."""
