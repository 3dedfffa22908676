"""Training-data operators: token roll-ups, de-duplication, secret scans, quality, packing, archives.

Nothing outside this subpackage imports it.
"""
