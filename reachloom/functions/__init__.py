"""reachloom.functions"""
