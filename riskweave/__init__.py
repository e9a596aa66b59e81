"""Spark-native enrichment, labelling, ranking and ranking evaluation of risk records."""
