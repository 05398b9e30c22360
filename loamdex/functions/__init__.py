"""loamdex.functions"""
