"""Column builders: text rules, languages, severities, versions, canonical JSON."""
