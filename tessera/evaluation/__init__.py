"""Relevance evaluation: ablation runs over one index and their report."""
