"""Writers: partitioned tables, CSV, XML, JSON and HTML rows."""
