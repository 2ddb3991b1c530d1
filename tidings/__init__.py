"""tidings: a content-update analytics engine on PySpark.

Landed feeds, pages and listings are read as DataFrames, normalized into one item table, merged
into a live store with permanent first-seen tracking, aged into a month-partitioned archive and
published as views and feeds.
"""
