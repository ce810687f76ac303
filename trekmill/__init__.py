"""Spark-first analytics over travel data: timetables, places, guides, alerts and packages."""
