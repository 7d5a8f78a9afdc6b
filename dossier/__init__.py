"""Registry records, legal conditions and their document trails, on Spark."""
