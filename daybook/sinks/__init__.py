"""Writers: JSON, CSV and Parquet, and table replacement."""
