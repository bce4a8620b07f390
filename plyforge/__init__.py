"""Plyforge: Spark-first analytics over datasets of game positions."""
