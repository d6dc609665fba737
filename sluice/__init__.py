"""Spark-native solicitation triage: DataFrame operators from raw message to scored, merged and digested opportunity."""
