"""Spark-native analytics over public-market disclosures: events, clusters, funds, portfolios, alerts."""
