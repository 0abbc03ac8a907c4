"""skeingraph.functions"""
