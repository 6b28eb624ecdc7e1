"""The ordered change log: batches, cursors, retention, materialised records."""
