"""Writers of files, tables and reports."""
