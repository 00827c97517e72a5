"""Operators on the texts of transcripts and documents."""
