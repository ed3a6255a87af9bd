"""threadlake.sources"""
