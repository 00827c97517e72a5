"""Session-transcript analytics on Spark: relational operators over corpora of agent transcripts and text corpora."""

__version__ = "0.1.0"
