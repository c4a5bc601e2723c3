"""karstline: a PySpark-native engine for spatial-capture metadata and corpus pipelines."""
