"""No streaming operators.

The work this library covers has none.  Extraction and matching with a small
rule table are row-local projections, so they also run on a streaming
DataFrame of files as they are (see ``tests/test_streaming.py``).
"""
