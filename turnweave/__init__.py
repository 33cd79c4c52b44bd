"""Spark operators that turn spoken-word transcripts and documents into knowledge tables."""
