"""Sources, the registry of sources, adapters, and sinks."""
