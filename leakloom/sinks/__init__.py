"""Writers and renderers of findings."""
