"""Sources: files, documents, scanner output, vulnerability feeds, audit logs, configuration."""
