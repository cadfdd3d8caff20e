"""reachloom.operators"""
