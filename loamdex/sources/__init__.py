"""loamdex.sources"""
