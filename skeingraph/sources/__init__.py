"""skeingraph.sources"""
