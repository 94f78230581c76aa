"""Text, token and archive operators for large corpora of notes and snapshots.

A note is a row with a whole-number key and a free text, as the weight-change
log's ``seq`` and ``reason``.  Nothing else in the library imports this package.
"""
