"""skeingraph.operators"""
