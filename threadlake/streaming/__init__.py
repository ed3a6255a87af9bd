"""threadlake.streaming"""
