"""Inputs and outputs: catalog tables, parquet paths, test mappings."""
