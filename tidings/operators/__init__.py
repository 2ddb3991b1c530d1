"""DataFrame -> DataFrame operators.

They are lazy, with two bounded exceptions: `classify.with_table_category` reads the head of its
rule table, and retention with a very large cap writes its sort keys out once.
"""
