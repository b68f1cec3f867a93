"""Attributed-event analytics on Spark.

Every event in a session is triggered by one member of a small team of actors.
The package measures how much each actor shifts a subject's rate, and whether
the shift is predictable from the team.
"""
