"""Sources: media descriptions, wave audio, picture folders, stage payloads."""
