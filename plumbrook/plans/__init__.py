"""Plan inspection, SQL files, DAG runs and configuration."""
