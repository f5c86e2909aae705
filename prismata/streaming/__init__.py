"""prismata.streaming"""
