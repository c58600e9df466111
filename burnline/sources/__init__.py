"""burnline.sources"""
