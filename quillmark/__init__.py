"""quillmark: review analytics and text-corpus preparation as PySpark jobs."""
