"""docket.sources"""
