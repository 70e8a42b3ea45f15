"""Analytics on risk-flag event tables, as plain functions from DataFrame to DataFrame."""
