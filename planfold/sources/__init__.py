"""Sources and sinks: derived test views, unit-mix files, versions, report bundles."""
