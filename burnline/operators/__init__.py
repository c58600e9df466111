"""burnline.operators"""
