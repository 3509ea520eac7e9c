"""Backup-fleet analytics as Spark DataFrame operators."""
