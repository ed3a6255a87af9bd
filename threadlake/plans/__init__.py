"""threadlake.plans"""
