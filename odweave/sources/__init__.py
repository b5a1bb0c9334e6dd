"""Readers and writers: delimited tables, point and WKT tables, raster cells."""
