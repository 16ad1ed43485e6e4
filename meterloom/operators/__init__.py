"""DataFrame → DataFrame operators.

``keys`` is a list of series-key columns and ``ts`` the time column. Windows are
always partitioned by the keys and run on rolled-up rows, one per key and time
slot, so a window partition is bounded by the length of the calendar and not by
the number of raw readings.
"""
