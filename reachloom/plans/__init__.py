"""reachloom.plans"""
