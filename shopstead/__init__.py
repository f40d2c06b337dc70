"""Catalogue intelligence on Spark: merchant pages, products, offers, evidence, ledgers and feeds as DataFrames."""
