"""threadlake.operators"""
