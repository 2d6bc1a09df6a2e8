"""Training-data operators. Nothing outside this package imports it; `registry` lists its queries."""
