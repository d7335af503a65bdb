"""kbspark: knowledge-base search, question-log analytics and content indexing as PySpark jobs."""
