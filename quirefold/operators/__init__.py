"""quirefold.operators"""
