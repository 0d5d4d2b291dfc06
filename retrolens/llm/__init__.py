"""Operators for preparing training corpora: ten text operators over the
tables documents, pages, benchmark, labels and conversations.

Nothing else in the library imports this subpackage.
"""
