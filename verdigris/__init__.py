"""verdigris: vector, document, catalog and work-queue analytics as PySpark DataFrame operators."""
