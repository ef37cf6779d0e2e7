"""The stateless stages applied to streaming DataFrames."""
