"""Structured Streaming: replay-safe staging, exactly-once import, stateful campaigns, stream-static checks.

The handlers of `foreachBatch` only append what isn't there yet, so a batch that runs twice adds nothing.
"""
