"""Mail forensics on Spark: parse, trace, score, link and evidence a corpus of messages."""
