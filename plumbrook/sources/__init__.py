"""Table locations, readers, lineage, and the file, workbook and JDBC sinks."""
