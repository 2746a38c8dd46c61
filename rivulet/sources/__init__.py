"""rivulet.sources"""
