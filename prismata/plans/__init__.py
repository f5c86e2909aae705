"""prismata.plans"""
