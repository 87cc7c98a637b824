"""docket.functions"""
