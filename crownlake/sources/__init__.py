"""Readers and writers: point clouds (PLY, LAS), rasters (TIFF), tables, parameter files, result logs."""
