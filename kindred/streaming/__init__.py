"""kindred.streaming"""
