"""Point-in-time recommendation analytics on Spark DataFrames.

Every operator takes DataFrames and dates and returns a lazy DataFrame. ``as_of`` is exclusive: no
operator reads a row on or after it unless its name says so (targets, truth, demo tables).
"""
