"""Continuous versions of the refreshed datasets.

Stateless columns, windows and keyed state run inside one streaming query;
flags that look back over rows are refreshed batch by batch with the same
operator that builds the whole table.
"""
