"""docket.streaming"""
