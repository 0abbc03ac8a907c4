"""skeingraph.streaming"""
