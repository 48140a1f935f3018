"""Incremental runs: results appended as they come, with what was deleted kept out."""
