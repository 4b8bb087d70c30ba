"""Spark jobs over the tables that video and audio analytics leave behind."""
