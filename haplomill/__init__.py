"""Spark-native haplotype assembly and phasing analytics."""
