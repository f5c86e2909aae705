"""prismata.operators"""
