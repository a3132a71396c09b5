"""Scans: parquet tables, project file trees, archives, XML/text reports, web inputs."""
