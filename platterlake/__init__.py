"""Spark-first analytics over retro-computing disc images, with training-data operators in ``llm``."""
