"""kindred.sources"""
