"""boxtrail: detection tables, event streams and dataset curation on PySpark."""
