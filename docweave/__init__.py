"""Batch and streaming Spark jobs that turn extracted trade paperwork into checked business records."""
