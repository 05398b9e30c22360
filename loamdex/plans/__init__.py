"""loamdex.plans"""
