"""prismata.sources"""
