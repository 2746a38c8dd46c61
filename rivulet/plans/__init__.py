"""rivulet.plans"""
