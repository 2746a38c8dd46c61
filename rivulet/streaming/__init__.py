"""rivulet.streaming"""
