"""rivulet.operators"""
