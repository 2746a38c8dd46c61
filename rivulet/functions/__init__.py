"""rivulet.functions"""
