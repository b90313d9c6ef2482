"""Cloudloom: point-cloud analytics and training-data operators as Spark DataFrame programs."""
