"""Change, freshness, alert and settlement streams; each has a batch twin."""
