"""quirefold.streaming"""
