"""loomgraph.operators"""
