"""Spark-native evidence analytics: chunking, hybrid retrieval, mechanical verification and scoring as DataFrame operators."""
