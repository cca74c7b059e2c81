"""millrace: exchange-centric analytics expressed as ordinary PySpark programs."""
