"""loamdex.operators"""
