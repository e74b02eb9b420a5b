"""Spark jobs for haplotype data: ingest, blocking, pair counts, composite likelihoods and demographic inference."""
