"""Tables: parquet inputs, materialised intermediates and the versioned vector table."""
