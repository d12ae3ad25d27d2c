"""Plan helpers: cutting lineage, spreading hot keys, splitting ordered scans."""
