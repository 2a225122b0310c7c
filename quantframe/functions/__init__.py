"""Part of quantframe."""
