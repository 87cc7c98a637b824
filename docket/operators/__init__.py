"""docket.operators"""
