"""Sources and sinks: grids, tables, files for viewers."""
