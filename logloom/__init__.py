"""Spark-native log analytics: parse rules, object models, lookups, routing and counters as DataFrame plans."""
