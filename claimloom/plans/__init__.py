"""Rule bodies: representation, validation and compilation to DataFrames."""
