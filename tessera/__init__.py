"""Tessera: skill-alignment analytics and corpus preparation on Spark."""
