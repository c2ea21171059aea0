"""Config-driven ingestion, batch control, task graphs and table lineage on Spark."""
