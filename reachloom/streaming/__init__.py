"""reachloom.streaming"""
