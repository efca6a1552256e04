"""Spark-native analytics over cells, districts, street networks and event calendars."""
