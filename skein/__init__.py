"""skein: document retrieval and its evaluation as DataFrame-to-DataFrame stages on Spark."""

__version__ = "0.1.0"
