"""reachloom.sources"""
