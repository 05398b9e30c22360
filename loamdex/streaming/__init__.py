"""loamdex.streaming"""
