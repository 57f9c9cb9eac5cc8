"""Sources, sinks, settings and model artefacts."""
