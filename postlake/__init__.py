"""Posting analytics on Spark: payload flattening, canonical projection, listings, lifecycle, dedup and matching."""
