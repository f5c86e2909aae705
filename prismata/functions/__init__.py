"""prismata.functions"""
