"""Auction and policy-news analytics as composable Spark DataFrame operators."""
