"""quillspark: PySpark-native analytics for exam-style document collections."""

__version__ = "0.1.0"
