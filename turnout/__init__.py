"""Audience analytics on Spark: composable ``DataFrame -> DataFrame`` operators.

Every table carries ``event_slug``; every aggregate that speaks of "the run"
is computed per event.  Answers of models, vendors and reviewers are input
tables; this package selects, merges, validates and measures them.
"""
