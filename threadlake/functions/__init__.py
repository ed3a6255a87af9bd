"""threadlake.functions"""
