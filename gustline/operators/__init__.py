"""DataFrame operators over observations: joins, aggregates and ordered scans."""
