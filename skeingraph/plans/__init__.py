"""skeingraph.plans"""
